"""Secret scans: base patterns, and sliding-window Shannon entropy per character class, in DataFrame functions only.

Base kinds are ``assign``, ``access`` and ``hex``: leftmost, non-overlapping matches, of which those that are too
short are dropped.  A span is the whole match, in code points, its end exclusive.

The entropy scan takes candidate strings (runs of base64 or hexadecimal characters with a digit and a letter), slides
a window over each and carries the count of every character in it (five bits each, in a few longs) and sum(c * log2 c)
over the counts, in whole 2^-40 of a bit: a character that leaves or enters changes one count and one term.  Long runs are cut into
stretches that overlap by a window less one, so time and memory are in proportion to the run and to a stretch.  The span reaches from the first to the last window whose entropy is at least that of
its class's threshold.  A candidate that an allow-list pattern matches whole is suppressed.  Maximal hexadecimal runs
of a window or more inside another candidate (a prefix joined by ``_``, ``-``, ``/`` or ``=``) are candidates of their
own at the hexadecimal threshold; their spans are told where the candidate's own span doesn't hold them.  The kinds
are ``entropy_hex`` and ``entropy_base64``; base spans stay whatever the scan finds.

Nulls: a null text is an empty one (no spans) and stays null when redacted; null ids and repeated rows are kept; an
empty table gives no rows; texts and candidates go whole, whatever their length.  Time is in proportion to the text.  The
functions below read ``doc_id``, ``text`` and ``n_chars`` and keep their own results in structs or under aliases.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from skyloom.llm.rowwise import let, running_max, running_sum, spread

#: Fixed patterns of the base kinds, each with the least length of what is kept (of group 2 for assign).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # maximal runs of 20 or more
HEX = r"[0-9a-f]{24,}"
#: Candidate strings of the entropy scan.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
WINDOW = 20
HEX_RUN = rf"[0-9A-Fa-f]{{{WINDOW},}}+"
#: Bits a character by class.
THRESHOLD = {"entropy_hex": 2.9, "entropy_base64": 3.7}
#: What is no secret although it may look random: UUIDs, numbers and dates, words with numbers after separators.
ALLOW = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"[0-9+/_=-]++[TZ]?+[0-9+/_=-]*+",
    r"/?+(?:[A-Za-z]++|[0-9]{1,8}+)(?:[-_/=](?:[A-Za-z]++|[0-9]{1,8}+))*+[-_/=]?+",
    r".*(?:EXAMPLE|example|xxxx|XXXX|0000000000).*",
)
#: Characters of candidates lie between these; a long holds so many counts of so many bits.
FIRST, LAST, LANES, BITS = ord("+"), ord("z"), 12, 5
STRETCH = 4096
#: What c * log2 c grows by at each count c of a window, in 2^-40.
GROWTH = [round(((c + 1) * math.log2(c + 1) - c * math.log2(c or 1)) * 2**40) for c in range(WINDOW)]
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")
SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"


def _none() -> Column:
    return F.array().cast(SPAN)


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<start, value>> of all matches."""
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, m: F.struct(F.length(gap).cast("long").alias("gap"), m.alias("value")))

    def placed(pairs: Column) -> Column:
        before = running_sum(F.transform(pairs, lambda p: p["gap"] + F.coalesce(F.length(p["value"]), F.lit(0))))
        both = F.zip_with(pairs, before, lambda p, b: F.struct((b + p["gap"]).alias("start"), p["value"].alias("value")))
        return F.filter(both, lambda p: p["value"].isNotNull())

    return let(pairs, placed)


def _span(start: Column, end: Column, kind: str) -> Column:
    return F.struct(start.cast("long").alias("start"), F.lit(KINDS.index(kind) + 1).alias("rank"), end.cast("long").alias("end"), F.lit(kind).alias("kind"))


def _base(text: Column, kind: str, pattern: str) -> Column:
    found = _matches(text, pattern)
    if kind == "assign":
        found = F.filter(found, lambda m: F.length(F.regexp_extract(m["value"], pattern, 2)) >= 6)
    spans = F.transform(found, lambda m: _span(m["start"], m["start"] + F.length(m["value"]), kind))
    return F.when(text.rlike(pattern), spans).otherwise(_none())


def _windows(text: str, most: str) -> str:
    """SQL for a struct<first, last>: ends (1-based) of the first and last window of ``text`` whose sum of terms is ``most`` at most,
    else nulls.  SQL text takes less time to build than columns."""
    longs, codes = range((LAST - FIRST) // LANES + 1), range(LAST - FIRST + 1)
    place, unit = (f"array({', '.join(f'{f(c)}{kind}' for c in codes)})" for f, kind in ((lambda c: c // LANES, ""), (lambda c: 1 << BITS * (c % LANES), "L")))
    growth = f"array({', '.join(f'{g}L' for g in GROWTH)})"
    count = lambda k, u: f"CAST((CASE {k} {' '.join(f'WHEN {n} THEN a.c{n}' for n in longs)} END) div {u} & {(1 << BITS) - 1} AS INT)"
    moved = ", ".join(f"'c{n}', a.c{n} + IF(p.k = {n}, p.u, 0L) - IF(p.gk = {n}, p.gu, 0L)" for n in longs)
    total = f"a.total - IF(p.gu > 0, get({growth}, {count('p.gk', 'p.gu')} - 1), 0L) + get({growth}, {count('p.k', 'p.u')} - IF(p.gk = p.k AND p.gu = p.u, 1, 0))"
    # whether the window before was over is told when counts move on
    over = f"a.i >= {WINDOW} AND a.total <= {most}"
    ends = f"'first', IF({over} AND a.first IS NULL, a.i, a.first), 'last', IF({over}, a.i, a.last)"
    begin = ", ".join(f"'c{n}', 0L" for n in longs)
    own = f"transform(split({text}, ''), x -> named_struct('k', get({place}, ascii(x) - {FIRST}), 'u', get({unit}, ascii(x) - {FIRST})))"
    steps = f"transform(all, (p, i) -> named_struct('k', p.k, 'u', p.u, 'gk', coalesce(get(all, i - {WINDOW}).k, -1), 'gu', coalesce(get(all, i - {WINDOW}).u, 0L)))"
    steps = f"flatten(transform(array({own}), all -> {steps}))"
    return f"aggregate({steps}, named_struct({begin}, 'total', 0L, 'i', 0, 'first', CAST(NULL AS INT), 'last', CAST(NULL AS INT)), (a, p) -> named_struct({moved}, 'total', {total}, 'i', a.i + 1, {ends}), a -> named_struct({ends}))"


def window_entropy(value: str, bits: float) -> str:
    """SQL for a struct<first, last>: ends (1-based) of the first and last window of ``value`` with at least so many bits a character, else nulls."""
    most = f"{math.floor((math.log2(WINDOW) - bits + 5e-10) * WINDOW * 2**40)}L"
    before = f"coalesce(right(get(parts, j - 1), {WINDOW - 1}), '')"
    windows = _windows(f"concat({before}, part)", most)
    found = f"transform(array({windows}), w -> named_struct('first', w.first + j * {STRETCH} - length({before}), 'last', w.last + j * {STRETCH} - length({before})))[0]"
    each = f"transform(array(regexp_extract_all({value}, '.{{1,{STRETCH}}}', 0)), parts -> transform(parts, (part, j) -> {found}))"
    return f"transform({each}, e -> named_struct('first', array_min(transform(e, w -> w.first)), 'last', array_max(transform(e, w -> w.last))))[0]"


def _candidates(text: Column, allow: tuple[str, ...]) -> Column:
    """array<struct<start, value, hexadecimal, inner>>: candidates to judge, ``inner`` the hexadecimal runs in one of another class. The
    value is null where it is nothing to judge."""

    def named(value: Column) -> Column:
        found = F.lit(False)
        for pattern in allow:
            found = found | value.rlike(f"^(?:{pattern})$")
        return found

    mixed = lambda value: value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    runs = lambda value: F.filter(_matches(value, HEX_RUN), lambda r: mixed(r["value"]) & ~named(r["value"]))
    none = F.array().cast("array<struct<start:bigint,value:string>>")

    def judged(m: Column) -> Column:
        value = m["value"]
        hexadecimal = value.rlike("^[0-9A-Fa-f]+$")
        inner = F.when(~hexadecimal & value.rlike(HEX_RUN), runs(value)).otherwise(none)
        return F.struct(m["start"].alias("start"), value.alias("value"), hexadecimal.alias("hexadecimal"), inner.alias("inner"))

    found = F.filter(_matches(text, CANDIDATE), lambda m: mixed(m["value"]) & ~named(m["value"]))
    return F.when(text.rlike(CANDIDATE), F.transform(found, judged)).otherwise(F.array().cast("array<struct<start:bigint,value:string,hexadecimal:boolean,inner:array<struct<start:bigint,value:string>>>>"))


def _judged_sql() -> str:
    """SQL for the entropy spans of ``_candidates``: each candidate's own and those of inner runs that it doesn't hold."""

    def span(start: str, value: str, kind: str) -> str:
        rank = KINDS.index(kind) + 1
        return f"transform(array({window_entropy(value, THRESHOLD[kind])}), w -> IF(w.first IS NULL, NULL, named_struct('start', {start} + w.first - {WINDOW}, 'rank', {rank}, 'end', {start} + w.last, 'kind', '{kind}')))[0]"

    own = f"IF(c.hexadecimal, {span('c.start', 'c.value', 'entropy_hex')}, {span('c.start', 'c.value', 'entropy_base64')})"
    inner = f"transform(c.inner, r -> {span('c.start + r.start', 'r.value', 'entropy_hex')})"
    apart = f"transform(array({own}), s -> array_append(filter({inner}, h -> h IS NOT NULL AND (s IS NULL OR h.start < s.start OR h.end > s.end)), s))[0]"
    return f"CAST(filter(flatten(transform(_candidates, c -> {apart})), s -> s IS NOT NULL) AS {SPAN})"


def _found(rows: DataFrame, allow: tuple[str, ...]) -> DataFrame:
    """``rows`` with spans (_assign, _access, _hex, _entropy) of their column _text, which is not null."""
    text = F.col("_text")
    base = [_base(text, k, p).alias(f"_{k}") for k, p in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX))]
    return rows.select("*", *base, _candidates(text, allow).alias("_candidates")).withColumn("_entropy", F.expr(_judged_sql())).drop("_candidates")


def _told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """doc_id, the number of each base kind, base_sha256, and all spans as text and as an array of structs."""
    rows = spread(docs).select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("_text"))
    rows = _found(rows, allow).select("*", F.array_sort(F.concat("_assign", "_access", "_hex")).alias("_base"), F.array_sort(F.concat("_assign", "_access", "_hex", "_entropy")).alias("found"))
    sizes = [F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex", "entropy")]
    return rows.select("doc_id", *sizes, F.sha2(_told(F.col("_base")).cast("binary"), 256).alias("base_sha256"), _told(F.col("found")).alias("spans"), "found")


def _pieces(text: Column, gaps: Column) -> Column:
    """The text of each of ``gaps`` (low, high).  The text is cut into stretches once and a gap is made of parts of those that it meets, so the
    time is in proportion to the text and the number of gaps."""
    stretches = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0))

    def piece(all_: Column, g: Column) -> Column:
        low, high = g["low"], g["high"]
        begin = lambda j: F.greatest(low, j * STRETCH)
        part = lambda j: F.substring(F.get(all_, j.cast("int")), (begin(j) - j * STRETCH + 1).cast("int"), (F.least(high, (j + 1) * STRETCH) - begin(j)).cast("int"))
        return F.when(high > low, F.array_join(F.transform(F.sequence(F.floor(low / STRETCH), F.floor((high - 1) / STRETCH)), part), "")).otherwise(F.lit(""))

    return let(stretches, lambda all_: F.transform(gaps, lambda g: piece(all_, g)))


def redacted(docs: DataFrame, mark: str = "[SECRET]", allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """The rows of ``docs`` with each secret in ``text`` replaced by ``mark`` and ``n_chars`` counted anew where that
    changed the text. Secrets that overlap or touch become one mark."""
    rows = _found(docs.select(F.struct("*").alias("_row"), F.coalesce("text", F.lit("")).alias("_text")), allow)
    text, spans = F.col("_text"), F.col("_spans")
    rows = rows.select("_row", "_text", F.array_sort(F.concat("_assign", "_access", "_hex", "_entropy")).alias("_spans"))
    reached = running_max(F.transform(spans, lambda s: s["end"]))
    gap = lambda low, high: F.struct(low.cast("long").alias("low"), high.cast("long").alias("high"))
    gaps = F.zip_with(spans, reached, lambda s, r: F.when((r == 0) | (s["start"] > r), gap(r, s["start"])))
    gaps = F.array_append(F.filter(gaps, lambda g: g.isNotNull()), gap(F.array_max(F.transform(spans, lambda s: s["end"])), F.length(text)))
    cut = F.array_join(_pieces(text, gaps), mark)
    old = F.col("_row")
    rows = rows.select("_row", F.when(F.size(spans) == 0, old["text"]).otherwise(cut).alias("_new"))
    new = {"text": F.col("_new")}
    if "n_chars" in docs.columns:
        changed = F.length("_new") != F.length(old["text"])
        new["n_chars"] = F.when(changed, F.length("_new")).otherwise(old["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return rows.select(*(new.get(c, old[c]).alias(c) for c in docs.columns))
