"""Pre-token tables: ids of a text as the ``tokenizers`` library gives them, one library call per distinct pre-token.

Byte pair merges never cross a pre-token, so the ids of a text are the ids of its pre-tokens, one after the
other.  A worker keeps the ids of the pre-tokens that it has met (``limit`` of them, in two generations, so memory
is bounded whatever the corpus holds) and asks the library only for new ones.

Normalizer and split are the file's own.  Special strings are cut out first, as the library does; each stretch between them goes
through the library's normalizer and pre-tokenizer.  Stretches of plain characters (tab, line ends, printable ASCII and the letters
and signs up to U+017F), where the classes of every regex library agree and where NFC changes nothing, are split here by the
same pattern, which takes less time; so they are only where the file's steps are of the kinds known below.
"""

from __future__ import annotations

import json
import re
from array import array
from collections import Counter
from operator import mul

#: Characters up to U+017F by Unicode class; \u0130 (its lower case is two characters) is left out.
CLASSES = {r"\p{L}": "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017f", r"\p{N}": "0-9\xb2\xb3\xb9\xbc-\xbe"}
#: Patterns without anything that matches white space or looks at what stands beside a match.
SPACE_BLIND = re.compile(r"(?:[a-zA-Z'|+]|\\p\{[LN]\}|\[(?:\\p\{[LN]\})+\]|\[\^\\s(?:\\p\{[LN]\})*\])+")
NOT_PLAIN = re.compile("[^\t\n\r\x20-\x7e\xa1-\u012f\u0131-\u017f]")
#: The byte of a character in byte-level vocabularies; printable ones stand for themselves, others for U+0100 and up.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARS = {b: b for b in _SHOWN} | {b: 256 + i for i, b in enumerate(sorted({*range(256)} - {*_SHOWN}))}
#: Characters of byte-level vocabularies back to bytes.
CHAR_BYTES = {c: b for b, c in BYTE_CHARS.items()}


def plain_split(pattern: str) -> re.Pattern:
    """``pattern`` with its Unicode classes spelled out for plain characters."""
    out, inside, at = "", False, 0
    while at < len(pattern):
        if (name := pattern[at : at + 5]) in CLASSES:
            out, at = out + (CLASSES[name] if inside else f"[{CLASSES[name]}]"), at + 5
            continue
        inside = pattern[at] == "[" or inside and pattern[at] != "]"
        step = 2 if pattern[at] == "\\" else 1
        out, at = out + pattern[at : at + step], at + step
    return re.compile(out)


def byte_chars(token: str) -> str:
    """The token's UTF-8 bytes, each as the character that stands for it."""
    return token.encode().decode("latin-1").translate(BYTE_CHARS)


class Table(dict):
    """Pre-token -> value, computed when first asked for.  ``turn()``: when full, what was not used since the last
    turn goes, so at most two times ``limit`` values are held."""

    def __init__(self, compute, limit: int):
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, token: str):
        value = self.old.get(token)
        if value is None:
            value = self.compute(token)
        self[token] = value
        return value

    def turn(self) -> None:
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()


class Encoder:
    """``path``: a tokenizers .json file of a byte-level vocabulary."""

    def __init__(self, path: str, limit: int = 400_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        told = json.loads(self.library.to_str())
        if any(a["normalized"] or a["single_word"] or a["lstrip"] or a["rstrip"] for a in told["added_tokens"]):
            raise ValueError("added tokens that depend on what stands beside them aren't supported")
        self.special = {a["content"]: a["id"] for a in told["added_tokens"]}
        self.cut = re.compile("|".join(f"({re.escape(t)})" for t in sorted(self.special, key=len, reverse=True)) or "(?!)")
        pattern = self._pattern(told["pre_tokenizer"])
        self.steps = self._plain_steps(told["normalizer"], pattern is not None and SPACE_BLIND.fullmatch(pattern) is not None)
        self.split = None if pattern is None or self.steps is None else plain_split(pattern).findall
        merge = self.library.model.tokenize
        self.ids = Table(lambda t: array("I", [p.id for p in merge(byte_chars(t))]).tobytes(), limit)
        self.counts = Table(lambda t: len(merge(byte_chars(t))), limit)

    @staticmethod
    def _pattern(told: dict | None) -> str | None:
        """The split's pattern where pre-tokens are its matches, each then shown byte by byte; else None."""
        import public_tokenizers

        steps = [told] if told and told["type"] != "Sequence" else (told or {}).get("pretokenizers", [])
        if not steps or steps[-1]["type"] != "ByteLevel" or steps[-1]["add_prefix_space"]:
            return None
        if len(steps) == 1 and steps[0]["use_regex"]:
            return public_tokenizers.PATTERN  # the library's own for this kind
        first = steps[0]
        if len(steps) == 2 and first["type"] == "Split" and first["behavior"] == "Removed" and first["invert"] and not steps[1]["use_regex"]:
            return first["pattern"].get("Regex")
        return None

    @staticmethod
    def _plain_steps(told: dict | None, space_blind: bool = False) -> list | None:
        """What the normalizer does to plain characters, as functions; None for kinds that aren't known here. ``space_blind``: the split
        takes runs of white space as it takes a single one, so what shortens them isn't needed."""
        steps = [] if told is None else told["normalizers"] if told["type"] == "Sequence" else [told]
        shortens = lambda s: s["type"] == "Replace" and s["pattern"] == {"Regex": r"\s+"} and s["content"] == " "
        if space_blind and all(s["type"] in ("Lowercase", "NFC") or shortens(s) for s in steps):
            steps = [s for s in steps if not shortens(s)]
        known = []
        for step in steps:
            if step["type"] == "Lowercase":
                known.append(str.lower)
            elif step["type"] == "Replace" and "Regex" in step["pattern"] and "\\p" not in step["pattern"]["Regex"]:
                known.append(lambda text, sub=re.compile(step["pattern"]["Regex"]).sub, to=step["content"].replace("\\", r"\\"): sub(to, text))
            elif step["type"] != "NFC":
                return None
        return known

    def pretokens(self, text: str) -> list[str]:
        """Of a text without special strings."""
        if self.split is not None and NOT_PLAIN.search(text) is None:
            for step in self.steps:
                text = step(text)
            return self.split(text)
        if self.library.normalizer is not None:
            text = self.library.normalizer.normalize_str(text)
        return [p.translate(CHAR_BYTES).encode("latin-1").decode() for p, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def has_special(self, text: str) -> bool:
        return any(s in text for s in self.special)

    def encode(self, text: str) -> bytes:
        """Ids of the text as little-endian unsigned 32-bit integers."""
        self.ids.turn()
        if not self.has_special(text):
            return b"".join(map(self.ids.__getitem__, self.pretokens(text)))
        parts = [p for p in self.cut.split(text) if p]
        return b"".join(array("I", [self.special[p]]).tobytes() if p in self.special else b"".join(map(self.ids.__getitem__, self.pretokens(p))) for p in parts)

    def frequencies(self, text: str) -> tuple[Counter, int]:
        """The text's pre-tokens, each with its frequency, and the number of special strings."""
        if not self.has_special(text):
            return Counter(self.pretokens(text)), 0
        parts = [p for p in self.cut.split(text) if p]
        found: Counter = Counter()
        for p in parts:
            if p not in self.special:
                found.update(self.pretokens(p))
        return found, sum(p in self.special for p in parts)

    def count(self, text: str) -> int:
        """Pieces of the text: pieces of each distinct pre-token times its frequency."""
        found, special = self.frequencies(text)
        self.counts.turn()
        return special + sum(map(mul, map(self.counts.__getitem__, found), found.values()))


_OPEN: dict[tuple, Encoder] = {}


def encoder(path: str, kind=Encoder) -> Encoder:
    """One per worker process and file."""
    if (kind, path) not in _OPEN:
        _OPEN[kind, path] = kind(path)
    return _OPEN[kind, path]


def release() -> None:
    """Frees the tables of this worker process, which Spark may have used for tokens before."""
    _OPEN.clear()
