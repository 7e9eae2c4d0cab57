"""Checking new batches of rows against everything accepted before, by fingerprints in rotated block tables.

A row's text (for videos, its canonical address) gets a 64-bit fingerprint of its character grams (for videos, those of the
code, within a site). Fingerprints are cut into pieces; each
table holds them with other pieces rotated to the front, as many of them as are left when ``max_bits`` are taken away. Two
fingerprints that differ in at most ``max_bits`` bits have the leading block of at least one table in common, so exact
look-ups in the tables find every such pair; Hamming distance and the text itself are verified after that. New
fingerprints are appended. The tables lie in folders by the first bits of the block, so a batch opens only those that
its own blocks lead to.
"""

from __future__ import annotations

import html
import math
import re
import uuid
from functools import lru_cache, reduce
from itertools import combinations
from urllib.parse import unquote

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.functions.arrow import map_rows
from talkmill.operators.skew import lookup_join
from talkmill.session import cut, shared_dir, spread

#: Bits by which fingerprints of one item may differ, and pieces that a fingerprint is cut into.
MAX_BITS, PIECES = 1, 2
#: Entries of one table that a folder of the store should have; compacting sets the number of folders by it.
FOLDER_ROWS = 4_000_000
#: Batches that may lie in a store one by one before they are brought together.
BATCHES = 32
GRAM = 4
#: site_hosts is a fixed small table; more hosts than this are refused rather than sent to every task.
MOST_HOSTS = 100_000

_ADDRESS = re.compile(r"^(?:[a-z][a-z0-9+.-]*:)?(?://)?(?:[^/@?#]*@)?([^/:?#]+)(?::\d*)?([^?#]*)(?:\?([^#]*))?", re.I)
_LINK = re.compile(r"^(?:https?:)?//|^[\w-]+(?:\.[\w-]+)+(?::\d+)?/", re.I)
_CODE = re.compile(r"[A-Za-z0-9_-]+")


def video_key(url: str | None, sites: dict[str, str | None]) -> str | None:
    """``site`` and code or episode number that ``url`` leads to, or None if it is blank or leads to no video of a known site.

    Scheme, port, case of the host, mobile and other hosts of a site, tracking parameters, fragments, escapes and
    forwarding hosts don't count; letter case in codes does.
    """
    seen: set[str] = set()
    while url and url not in seen:  # forwarders may be nested; each step takes one off
        seen.add(url)
        if not (url := html.unescape(url).strip()):
            return None
        m = _ADDRESS.match(url)
        if not m:
            return None
        host = m[1].lower().rstrip(".")
        if host not in sites:
            return None
        query = [(k.lower(), unquote(v)) for k, _, v in (p.partition("=") for p in re.split(r"[&;]", m[3] or ""))]
        if (site := sites[host]) is None:
            url = next((v for _, v in query if _LINK.match(v.strip())), None)
            continue
        given = dict(reversed(query))
        path = [unquote(p).strip() for p in m[2].split("/") if p.strip()]
        low = [p.lower() for p in path]
        number = given.get("ep") or given.get("episode") or next((path[i + 1] for i, p in enumerate(low[:-1]) if p in ("episode", "episodes", "ep")), None)
        if number is not None and number.strip().isdecimal():
            return f"{site} #{int(number)}"
        code = given.get("v") or next((path[i + 1] for i, p in enumerate(low[:-1]) if p in ("embed", "live", "item", "v", "watch", "shorts")), None)
        if code is None and len(path) == 1 and low[0] not in ("watch", "embed", "live", "item", "show", "out"):
            code = path[0]
        m = _CODE.match(code.strip()) if code else None
        return f"{site} {m[0]}" if m else None
    return None


def _signs(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int16) * 2 - 1


@lru_cache(maxsize=100_000)
def _gram(g: str, kind: str) -> int:
    return xxhash.xxh3_64_intdigest(g, _kind(kind))


@lru_cache(maxsize=100_000)
def _kind(kind: str) -> int:
    return xxhash.xxh3_64_intdigest(kind) if kind else 0


def fingerprints(texts: list[str | None], gram: int = GRAM, kinds: list[str | None] | None = None) -> list[int | None]:
    """64-bit fingerprints in which texts with most of their character grams in common differ in few bits.

    Each bit is what most of the grams have there. All weigh nearly, but no two quite the same, so that even the few
    grams of a short text leave hardly a bit undecided. Only texts of one of the ``kinds`` (sites, for addresses) are near each other, so a
    beginning that all texts of a kind share needn't be in the texts, where it would fill blocks of the tables. Null
    stays null; equal texts of a kind have equal fingerprints.
    """
    hashes, starts, out = [], [], [None] * len(texts)
    for t, kind in zip(texts, kinds or [""] * len(texts)):
        if t is None:
            continue
        starts.append(len(hashes))
        hashes += [_gram(g, kind or "") for g in sorted({t[i : i + gram] for i in range(max(1, len(t) - gram + 1))})]
    if not hashes:
        return out
    h = np.array(hashes, np.uint64)
    # From 1 to 1.25, in whole numbers, by bits that a multiplication mixes, as the hash's own are the signs.
    weights = (1 << 14) + ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)).astype(np.int64)
    sums = np.add.reduceat(_signs(h) * weights[:, None], starts)
    prints = iter(np.packbits(sums > 0, axis=1).view(">u8").ravel().astype(np.int64).tolist())
    return [None if t is None else next(prints) for t in texts]


def keyed(videos: DataFrame, site_hosts: DataFrame, *keep: str) -> DataFrame:
    """(row_id, key, print) and ``keep`` of each row; both null where ``source_url`` leads to no video. One pass, no shuffle."""
    rows = site_hosts.select("host", "site").limit(MOST_HOSTS + 1).collect()
    if len(rows) > MOST_HOSTS:
        raise ValueError(f"more than {MOST_HOSTS} hosts")
    sites = {r.host.strip().lower(): r.site for r in rows if r.host}

    def fn(_: None, ids: list, urls: list, *rest: list) -> list:
        keys = [video_key(u, sites) for u in urls]
        parts = [(None, None) if k is None else k.rsplit(" ", 1) for k in keys]
        return [ids, keys, fingerprints([code for _, code in parts], kinds=[site for site, _ in parts]), *rest]

    kinds = "".join(f", `{c}` {videos.schema[c].dataType.simpleString()}" for c in keep)
    return map_rows(videos.select("row_id", "source_url", *keep), f"row_id long, key string, print long{kinds}", fn)


def block_width(max_bits: int = MAX_BITS, pieces: int = PIECES) -> int:
    return 64 // pieces * (pieces - max_bits)


def blocks(df: DataFrame, max_bits: int = MAX_BITS, pieces: int = PIECES) -> DataFrame:
    """``df`` once for each table: adds t and block, the pieces of ``print`` that lead in table t.

    There are as many tables as ways to leave ``max_bits`` of the ``pieces`` out; more pieces make longer blocks, so
    fewer candidates, in more tables.
    """
    if not 0 <= max_bits < pieces <= 64:
        raise ValueError("there must be more pieces than bits that may differ, and at most 64")
    width = 64 // pieces
    piece = lambda k: F.shiftrightunsigned("print", 64 - width * (k + 1)).bitwiseAND((1 << width) - 1)
    lead = lambda ks: reduce(lambda a, k: F.shiftleft(a, width).bitwiseOR(piece(k)), ks[1:], piece(ks[0])) if width < 64 else F.col("print")
    tables = enumerate(combinations(range(pieces), pieces - max_bits))
    return df.withColumn("_b", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), lead(ks).alias("block")) for t, ks in tables]))).select("*", "_b.t", "_b.block").drop("_b")


def look_up(probe: DataFrame, tables: DataFrame, max_bits: int = MAX_BITS, pieces: int = PIECES, same: Column | None = None) -> DataFrame:
    """(key, n, first_row_id): for each probe (key, print, n) the earliest entry of ``tables`` with the same text.

    ``tables`` has t, block, print, key, first_row_id. Candidates share a block exactly; then the distance is
    verified and the text, by ``same`` over a.key and b.key, equality if it isn't given.
    """
    a, b = blocks(probe.select("key", "print", "n"), max_bits, pieces).alias("a"), tables.alias("b")
    near = F.bit_count(F.col("a.print").bitwiseXOR(F.col("b.print"))) <= max_bits
    same = F.col("a.key") == F.col("b.key") if same is None else same
    hit = a.join(b, (F.col("a.t") == F.col("b.t")) & (F.col("a.block") == F.col("b.block"))).filter(near & same)
    return hit.groupBy(F.col("a.key").alias("key")).agg(F.max("a.n").alias("n"), F.min("b.first_row_id").alias("first_row_id"))


def entries(rows: DataFrame) -> DataFrame:
    """One row (key, print, first_row_id, n) a text; copies are folded by each task before anything is shuffled."""
    return rows.filter(F.col("key").isNotNull()).groupBy("key", "print").agg(F.min("row_id").alias("first_row_id"), F.count(F.lit(1)).alias("n"))


def repeats(rows: DataFrame, own: DataFrame, tables: DataFrame, max_bits: int = MAX_BITS, pieces: int = PIECES, total: int | None = None) -> DataFrame:
    """(first_row_id, row_id) of each row whose text an entry of ``tables`` with a smaller id has; ``own`` has the entries of ``rows``, of which there are ``total``."""
    known = look_up(own, tables, max_bits, pieces)
    total = own.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] if total is None else total
    found = lookup_join(rows.filter(F.col("key").isNotNull()).select("row_id", "key"), known, "key", total=total)
    return found.filter("first_row_id < row_id").select("first_row_id", "row_id").distinct()


class PrintStore:
    """The block tables of all accepted batches, as Parquet files under ``path``: bits=/batch=/t=/p=, p being the first ``bits`` bits of the block.

    Writing a batch again replaces its folder, so a job that died half-way is simply run again. ``compact`` brings the
    batches of the store together and sets ``bits`` so that a folder keeps its size as the history grows; what a batch
    reads then depends on the number of its own blocks.
    """

    kind = "key string, print long, first_row_id long, n long, block long, batch string, t int, p long"

    def __init__(self, spark: SparkSession, path: str, max_bits: int = MAX_BITS, pieces: int = PIECES, bits: int = 0, folder_rows: int = FOLDER_ROWS, batches: int = BATCHES):
        self.spark, self.path, self.max_bits, self.pieces, self.bits, self.folder_rows, self.batches = spark, path.rstrip("/"), max_bits, pieces, bits, folder_rows, batches
        self.width = block_width(max_bits, pieces)

    def _fs(self) -> tuple:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _layouts(self) -> list[int]:
        """The numbers of bits that the parts of the store are laid out by: one, or two after a compaction and before the next."""
        _, p, fs = self._fs()
        return sorted(int(s.getPath().getName()[5:]) for s in fs.listStatus(p) if s.getPath().getName().startswith("bits=")) if fs.exists(p) else []

    def _folders(self) -> list:
        jvm, _, fs = self._fs()
        return [s.getPath() for b in self._layouts() for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{self.path}/bits={b}"))]

    def _part(self, bits: int) -> Column:
        return F.shiftrightunsigned("block", self.width - bits).cast("long") if bits else F.lit(0).cast("long")

    def _write(self, own: DataFrame, bits: int, batch: str, total: int) -> None:
        tables = blocks(own, self.max_bits, self.pieces).select("key", "print", "first_row_id", "n", "block", "t", self._part(bits).alias("p"))
        # A folder is written by as many tasks as it has multiples of its size, each in order of blocks, so that a look-up skips row groups.
        salt = F.pmod(F.xxhash64("block"), F.lit(max(1, math.ceil(total / self.folder_rows / 2**bits))))
        tables.repartition("t", "p", salt).sortWithinPartitions("t", "p", "block").write.mode("overwrite").partitionBy("t", "p").parquet(f"{self.path}/bits={bits}/batch={batch}")

    def tables(self, own: DataFrame | None = None, but: str | None = None) -> DataFrame:
        """All tables, or of them the folders that the entries ``own`` lead to, without batch ``but``."""
        out = self.spark.createDataFrame([], self.kind)
        for bits in self._layouts():
            part = self.spark.read.schema(self.kind).option("basePath", f"{self.path}/bits={bits}").parquet(f"{self.path}/bits={bits}")
            if but is not None:
                part = part.filter(F.col("batch") != but)
            if own is not None and bits:
                # At most as many rows as the layout has folders; the filter is on folders alone, so no others are opened.
                led = [r.f for r in blocks(own, self.max_bits, self.pieces).select((F.col("t") * (1 << bits) + self._part(bits)).alias("f")).distinct().collect()]
                part = part.filter((F.col("t") * (1 << bits) + F.col("p")).isin(led)) if led else part.limit(0)
            out = out.unionByName(part)
        return out

    def check(self, rows: DataFrame, batch: str) -> DataFrame:
        """(first_row_id, row_id) of the rows of this batch that repeat an accepted row or an earlier row of the batch."""
        own = entries(rows)
        return self._check(rows, own, blocks(own, self.max_bits, self.pieces), batch)

    def _check(self, rows: DataFrame, own: DataFrame, new: DataFrame, batch: str, total: int | None = None) -> DataFrame:
        columns = ["key", "print", "first_row_id", "t", "block"]
        every = self.tables(own, batch).select(columns).unionByName(new.select(columns))
        return repeats(rows, own, every, self.max_bits, self.pieces, total)

    def append(self, rows: DataFrame, batch: str) -> None:
        own = entries(rows)
        self._write(own, max([self.bits, *self._layouts()]), batch, own.count())

    def accept(self, rows: DataFrame, batch: str, total: int | None = None) -> DataFrame:
        """What :meth:`check` gives, materialised; the batch is appended. ``total`` is the number of its rows where that is known.

        The batch's own tables are written first and read for the look-up, so its entries are made once. They don't
        count as history, so a batch that is given again gets the same answer.
        """
        bits, total = max([self.bits, *self._layouts()]), rows.count() if total is None else total
        self._write(entries(rows), bits, batch, total)
        new = self.spark.read.schema(self.kind).parquet(f"{self.path}/bits={bits}/batch={batch}")
        found = cut(self._check(rows, new.filter("t = 0").select("key", "print", "first_row_id", "n"), new, batch, total))
        if len(self._folders()) > self.batches:
            self.compact()
        return found

    def remove(self) -> None:
        _, p, fs = self._fs()
        fs.delete(p, True)

    def compact(self) -> None:
        """All batches as one, with the earliest entry of each text, in folders of at most about ``folder_rows`` entries of one table."""
        jvm, p, fs = self._fs()
        old = self._folders()
        if not old:
            return
        every = cut(self.tables().filter("t = 0").groupBy("key", "print").agg(F.min("first_row_id").alias("first_row_id"), F.sum("n").alias("n")))
        n = every.count()
        bits = min(self.width - 1, max(self.bits, math.ceil(math.log2(max(1, n / self.folder_rows)))))
        # The new folder has a name of its own; the old ones go once it is whole. Until then entries are there twice, which a minimum bears.
        self._write(every, bits, f"all-{uuid.uuid4().hex}", n)
        for q in old:
            fs.delete(q, True)
        for b in self._layouts():
            q = jvm.org.apache.hadoop.fs.Path(f"{self.path}/bits={b}")
            if not fs.listStatus(q):
                fs.delete(q, True)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each batch of videos in turn against the tables of all batches before it, after which its own entries are appended.

    Null and blank addresses, and those of no known site, are no cases; ties on row_id can't match; a null batch
    comes first; an empty table gives no rows; other columns are not read. Ids grow with the batches.
    """
    videos = spark.read.parquet(f"{sf_dir}/videos.parquet")
    rows = cut(keyed(spread(videos.select("row_id", "source_url", "batch_no")), spark.read.parquet(f"{sf_dir}/site_hosts.parquet"), "batch_no"))
    # A row a batch; the batches are gone through one after another, as they would arrive.
    batches = sorted(((r.batch_no, r.n) for r in rows.groupBy("batch_no").agg(F.count(F.lit(1)).alias("n")).collect()), key=lambda b: (b[0] is not None, b[0]))
    store = PrintStore(spark, f"{shared_dir(spark)}/prints-{uuid.uuid4().hex}")
    found = [store.accept(rows.filter(F.col("batch_no").eqNullSafe(F.lit(b))), str(b), n) for b, n in batches]
    store.remove()  # the answers are materialised; a store that is to be kept has a place of its own
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "first_row_id long, row_id long")
