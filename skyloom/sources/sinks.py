"""What a run leaves: Parquet maps, HEALPix FITS files, residuals, parameters, ASCII matrices."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.datasource import DataSource

from skyloom.sources import staging
from skyloom.sources.stores import NamedWriter

#: The names of coordinate systems in the files.
COORDINATES = {"G": "G       ", "E": "E       ", "C": "C       ", "Q": "C       "}
#: Numbers of a map that a writer holds.
CELLS = 1 << 20
NAMES = (("i", "mapI"), ("q", "mapQ"), ("u", "mapU"), ("rcond", "Cond"), ("hits", "Hits"))


def _card(key: str, value, comment: str = "") -> bytes:
    shown = ("T" if value else "F").rjust(20) if isinstance(value, bool) else str(value).rjust(20) if isinstance(value, int) else f"'{value:<8}'".ljust(20)
    return f"{key:<8}= {shown}{' / ' + comment if comment else ''}".ljust(80).encode()


def _header(cards: Iterable[bytes]) -> bytes:
    text = b"".join(cards) + b"END".ljust(80)
    return text.ljust(-(-len(text) // 2880) * 2880)


def _fits_header(nside: int, coordinates: str) -> bytes:
    """An empty primary unit and the head of a table with the one column SIGNAL."""
    if coordinates[:1].upper() not in COORDINATES:
        raise ValueError(f"unknown coordinate system {coordinates}")
    primary = _header([_card("SIMPLE", True), _card("BITPIX", 16), _card("NAXIS", 0), _card("EXTEND", True)])
    return primary + _header([
        _card("XTENSION", "BINTABLE"), _card("BITPIX", 8), _card("NAXIS", 2), _card("NAXIS1", 8), _card("NAXIS2", 12 * nside * nside), _card("PCOUNT", 0), _card("GCOUNT", 1), _card("TFIELDS", 1),
        _card("TTYPE1", "SIGNAL"), _card("TFORM1", "1D"), _card("PIXTYPE", "HEALPIX", "HEALPIX pixelisation"), _card("ORDERING", "NESTED"), _card("NSIDE", nside), _card("COORDSYS", COORDINATES[coordinates[:1].upper()]),
    ])


def fits_pieces(batches: Iterable[tuple[np.ndarray, np.ndarray]], nside: int, coordinates: str = "C") -> Iterator[bytes]:
    """A HEALPix map as FITS from (pixels, values) in ascending order of pixels, which needn't be all: others are 0."""
    yield _fits_header(nside, coordinates)
    at, most = 0, 12 * nside * nside
    for pix, values in batches:
        if not len(pix):
            continue
        if pix[0] < at or pix[-1] >= most or (np.diff(pix) <= 0).any():
            raise ValueError("pixels must ascend within the sphere")
        for low in range(at, int(pix[-1]) + 1, CELLS):  # also where the next pixel is far
            some = np.zeros(min(CELLS, int(pix[-1]) + 1 - low), ">f8")
            own = slice(*np.searchsorted(pix, [low, low + len(some)]))
            some[pix[own] - low] = values[own]
            yield some.tobytes()
        at = int(pix[-1]) + 1
    for low in range(at, most, CELLS):
        yield bytes(8 * min(CELLS, most - low))
    yield bytes(-8 * most % 2880)


def fits_map(values: np.ndarray, nside: int, coordinates: str = "C") -> bytes:
    """A whole map as FITS."""
    if len(values) != 12 * nside * nside:
        raise ValueError("the map must cover the sphere")
    return b"".join(fits_pieces([(np.arange(len(values)), np.asarray(values, float))], nside, coordinates))


def read_fits_map(blob: bytes) -> tuple[dict[str, str], np.ndarray]:
    """The table's header and its column."""

    def cards(at: int) -> tuple[dict[str, str], int]:
        out: dict[str, str] = {}
        while True:
            block = blob[at : at + 2880]
            at += 2880
            for k in range(0, 2880, 80):
                card = block[k : k + 80].decode()
                if card.startswith("END "):
                    return out, at
                if card[8:10] == "= ":
                    out[card[:8].strip()] = card[10:].split(" / ")[0].strip().strip("'").strip()

    _, at = cards(0)
    head, at = cards(at)
    return head, np.frombuffer(blob, ">f8", int(head["NAXIS2"]), at).astype(float)


class _MapWriter(NamedWriter):
    """One file from (pix, value) rows in order, all in one task, which holds a batch and ``CELLS`` numbers of it."""

    def __init__(self, path: str, name: str, nside: int, coordinates: str):
        super().__init__(path)
        self.name, self.nside, self.coordinates = name, nside, coordinates

    def pieces(self, batches):
        rows = ((b["pix"].to_numpy(), b["value"].to_numpy()) for b in batches)
        return ((self.name, piece) for piece in fits_pieces(rows, self.nside, self.coordinates))


class _PartsWriter(NamedWriter):
    """Four files a task, named by the task's number."""

    def pieces(self, batches):
        from pyspark import TaskContext

        k = TaskContext.get().partitionId()
        for name, _ in PARTS.values():
            yield f"{name}{k}.dat", b""
        for b in batches:
            for column, (name, kind) in PARTS.items():
                yield f"{name}{k}.dat", b[column].to_numpy(zero_copy_only=False).astype(kind).tobytes()


class MapFiles(DataSource):
    """Option ``what``: ``fits`` (rows pix, value; options name, nside, coordinates) or ``parts``."""

    @classmethod
    def name(cls) -> str:
        return "skyloom_maps"

    def schema(self) -> str:
        return "pix long, value double"

    def writer(self, schema, overwrite: bool) -> NamedWriter:
        o = self.options
        return _PartsWriter(o["path"]) if o["what"] == "parts" else _MapWriter(o["path"], o["name"], int(o["nside"]), o["coordinates"])


def write_fits(sky: DataFrame, column: str, path: str, name: str, nside: int, coordinates: str = "C") -> None:
    """A column of the observed sky as one FITS file, written by an executor as the sorted pixels pass."""
    sky.sparkSession.dataSource.register(MapFiles)
    rows = sky.select(F.col("pix").cast("long").alias("pix"), F.col(column).cast("double").alias("value")).orderBy("pix").coalesce(1)
    rows.write.format("skyloom_maps").mode("append").options(what="fits", name=name, nside=nside, coordinates=coordinates).save(path)


def write_products(maps, config) -> None:
    """Parquet of the observed sky, five FITS files, residuals (binary doubles and text) and the parameters."""
    from skyloom.plans.config import as_toml

    out, ref, spark = config.path_output.rstrip("/"), config.ref, maps.sky.sparkSession
    for _, name in NAMES:
        staging.removed(spark, f"{out}/{name}_{ref}.fits")  # raises before anything is written
    maps.sky.write.mode("overwrite").parquet(f"{out}/sky_{ref}.parquet")
    sky = spark.read.parquet(f"{out}/sky_{ref}.parquet")
    for column, name in NAMES:
        write_fits(sky, column, out, f"{name}_{ref}.fits", config.nside, config.coordinates)
    staging.put(spark, f"{out}/pcg_residuals_{ref}.dat", struct.pack(f"<{len(maps.residuals)}d", *maps.residuals))
    staging.put(spark, f"{out}/residuals_{ref}.txt", "".join(f"{r:.15e}\n" for r in maps.residuals).encode())
    staging.put(spark, f"{out}/parameters_{ref}.toml", as_toml(config).encode())


#: Fixed formats of a map part's files: column -> the files' name before the part's number, and numpy type.
PARTS = {"pix": ("mapout_lstid_", "<i4"), "hits": ("mapout_lhits_", "<i4"), "rcond": ("mapout_lcond_", "<f8"), "i": ("mapout_", "<f8")}


def write_map_parts(sky: DataFrame, path: str, parts: int = 1) -> None:
    """The observed sky (pix, hits, rcond, i) as binary parts by ranges of pixels: four files each, all in one job, a task a part."""
    sky.sparkSession.dataSource.register(MapFiles)
    rows = sky.select(*PARTS).repartitionByRange(parts, "pix").sortWithinPartitions("pix")
    rows.write.format("skyloom_maps").mode("append").option("what", "parts").save(path)


def write_spectra(spectra: DataFrame, path: str) -> None:
    """Periodograms or fitted spectra (block, k, f, power) for looking at."""
    spectra.write.mode("overwrite").parquet(path)


def write_ell(wide: DataFrame, path: str) -> None:
    """(row, cols, vals) as lines ``idx val idx val ...`` in the order of rows."""
    pairs = F.flatten(F.zip_with("cols", "vals", lambda c, v: F.array(c.cast("string"), v.cast("string"))))
    wide.orderBy("row").select(F.array_join(pairs, " ").alias("value")).write.mode("overwrite").text(path)
