"""Removal of repeated byte strings: column-wise suffix sorting of the pieces that can hold them.

A string of ``length`` bytes has an anchor: the leftmost of its k-grams with the least hash. Equal strings have equal
anchors at equal places, so texts are cut into pieces, each the strings of one anchor, and only pieces with one anchor
are compared. They are put side by side at their anchors and sorted column by column from the right: each round
inserts one symbol per piece and updates the order of all suffixes (whose symbols before are the collection's
Burrows-Wheeler transform) and the common prefixes of neighbours. Common prefixes tell strings of any length apart, so
one sort finds those of ``length`` bytes, which are removed, and those of ``passage`` bytes, which are counted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import REMEMBERED, as_bytes, bucketed, few_copies, forget, join_one, slices, table, written
from .jaccard import mixed

#: Bytes of an anchor; a power of two.
GRAM = 64
#: Pieces that a task sorts at a time, and pieces of one anchor beyond which they are dealt out further.
SORTED, CROWD = 16_384, 8_192
#: Bytes of a repeated passage that is counted though it is too short to be removed: most of over 50 words have more.
PASSAGE = 256
#: Longer texts are searched for anchors in segments of so many bytes.
SEGMENT = 1 << 23
#: The greatest number that a piece's description holds; strings are shorter than half of it.
NUMBER = (1 << 20) - 1
#: Bytes of text in one bucket of the table of texts.
BUCKET = 128 << 20
#: Hash bits compared to choose an anchor; the others hold the place.
PLACE = np.uint64((1 << 24) - 1)
FACTORS = mixed(np.arange(1000, 1000 + GRAM, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)
LETTER = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each place on, by doubling."""
    h, span = LETTER[data], 1
    while span < GRAM:
        h = h[:-span] * FACTORS[span : span + 1] + h[span:]
        h = h ^ (h >> np.uint64(29))
        span *= 2
    return mixed(h)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, from block-wise minima to the left and to the right."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def pieces(text: bytes, length: int) -> list[tuple[int, int, int, int]]:
    """(anchor's hash, anchor's place, first start, last start) of the strings of ``length`` bytes, by anchor."""
    out: list[tuple[int, int, int, int]] = []
    for at in range(0, max(0, len(text) - length + 1), SEGMENT):
        data = np.frombuffer(text, np.uint8, min(SEGMENT + length - 1, len(text) - at), at)
        h = gram_hashes(data)
        place = (sliding_min((h & ~PLACE) | np.arange(len(h), dtype=np.uint64), length - GRAM + 1) & PLACE).astype(np.int64)
        cuts = np.append(0, np.flatnonzero(np.diff(place)) + 1)
        ends = np.append(cuts[1:], len(place)) - 1
        out += zip(h[place[cuts]].view(np.int64).tolist(), (place[cuts] + at).tolist(), (cuts + at).tolist(), (ends + at).tolist(), strict=True)
    return out


def sort_columns(data: list[bytes], groups: np.ndarray, start: np.ndarray, lengths: list[int], low: np.ndarray, high: np.ndarray) -> list[list[list[tuple[int, int]]]]:
    """For each of ``lengths``, which starts of each piece begin a string of so many bytes that another piece of its group has too.

    ``start``: the column of a piece's first byte; pieces are in order of their groups. Returns ranges of columns
    (first, last) between ``low`` and ``high``.

    One round a column, from the last to the first. ``order`` lists the pieces by group and by what stands from the
    column on; ``common`` holds how far each agrees with the one before it. Inserting a column sorts stably by its
    symbol; two new neighbours agree by one more than the least agreement between their old places.
    """
    m = len(data)
    ends = start + np.array([len(x) for x in data])
    first, width = int(start.min()), int(ends.max() - start.min())
    symbols = np.zeros((width, m), np.int16)
    for k, x in enumerate(data):
        symbols[start[k] - first : ends[k] - first, k] = np.frombuffer(x, np.uint8)
        symbols[start[k] - first : ends[k] - first, k] += 1
    order = np.arange(m)
    common = np.zeros(m, np.int32)
    found = [np.zeros((width, m), bool) for _ in lengths]
    longest = max(lengths)
    key = groups.astype(np.int64) * 257
    for c in range(width - 1, -1, -1):
        column = symbols[c][order]
        code = key[order] + column
        new = np.argsort(code, kind="stable")
        code = code[new]
        same = np.append(False, code[1:] == code[:-1]) & (column[new] > 0)
        at = np.flatnonzero(same)
        u, v = new[at - 1], new[at]
        least = common[v]
        far = np.flatnonzero(v - u > 1)
        if len(far):
            bounds = np.column_stack([u[far] + 1, np.minimum(v[far] + 1, m)]).ravel()
            least[far] = np.minimum.reduceat(np.append(common, np.int32(1 << 30)), bounds)[::2]
        common = np.zeros(m, np.int32)
        common[at] = np.minimum(least + 1, longest)
        order = order[new]
        for n, hit in zip(lengths, found, strict=True):
            full = common >= n
            if full.any():
                full[:-1] |= full[1:]
                hit[c, order[full]] = True
    columns = np.arange(width)[:, None] + first
    inside = (columns >= low) & (columns <= high)
    return [_runs(hit & inside, first) for hit in found]


def _runs(found: np.ndarray, first: int) -> list[list[tuple[int, int]]]:
    """The ranges of rows (first, last), numbered from ``first``, in which each column is true."""
    m = found.shape[1]
    out: list[list[tuple[int, int]]] = [[] for _ in range(m)]
    edge = np.diff(np.vstack([np.zeros(m, np.int8), found.astype(np.int8), np.zeros(m, np.int8)]), axis=0).T
    for k in np.flatnonzero(found.any(axis=0)).tolist():
        out[k] = [*zip((np.flatnonzero(edge[k] == 1) + first).tolist(), (np.flatnonzero(edge[k] == -1) + first - 1).tolist(), strict=True)]
    return out


SPANS = pa.list_(pa.struct([("a", pa.int64()), ("z", pa.int64()), ("n", pa.int64())]))
PIECE = pa.struct([("gram", pa.int64()), ("hash", pa.int64()), ("a", pa.int64()), ("pack", pa.int64())])
RANGES = "gram long, hash long, spans array<struct<a:long,z:long,n:long>>"


def _keyed(df: DataFrame, text: str) -> DataFrame:
    """(key, text, again): texts by their md5, without the copies of those that very many rows have."""
    other = [F.col(f"`{f.name}`") for f in df.schema if f.name != text and "map<" not in f.dataType.simpleString()]
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    own = F.xxhash64(*other).alias("by") if other else F.lit(0).cast("long").alias("by")
    rows = df.select(whole.alias("text"), own).select(F.unhex(F.md5("text")).alias("key"), "text", "by")
    return few_copies(rows, "key", [F.col("by")]).drop("by")


def _texts(df: DataFrame, text: str) -> DataFrame:
    """(id, key, text, times): the texts of ``df``, dealt by number, so that they are joined twice but shuffled once.

    Copies in a batch are one row, ``times`` their number; a task hands on a text that comes in further batches once
    more, which tells that it is repeated. Numbers are fixed, as the table is written.
    """

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[bytes, int] = {}
        for batch in batches:
            first: dict[bytes, int] = {}
            times: dict[bytes, int] = {}
            for i, (k, again) in enumerate(zip(batch.column("key").to_pylist(), batch.column("again").to_pylist(), strict=True)):
                first.setdefault(k, i)
                times[k] = times.get(k, 0) + 1 + again
            new = [k for k in first if met.get(k, 0) < 2]
            for k in new:
                if k in met or len(met) < REMEMBERED:
                    met[k] = met.get(k, 0) + 1
            if new:
                some = batch.take(pa.array([first[k] for k in new], pa.int64()))
                yield pa.RecordBatch.from_arrays([some.column("key"), some.column("text"), pa.array([times[k] for k in new], pa.int64())], names=["key", "text", "times"])

    found = _keyed(df, text).mapInArrow(once, "key binary, text string, times long").withColumn("id", F.monotonically_increasing_id())
    size = df.agg(F.coalesce(F.sum(F.octet_length(F.col(f"`{text}`"))), F.lit(0))).first()[0]
    return bucketed(found, "id", max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / BUCKET)))


def repeated_spans(texts: DataFrame, length: int = 400, passage: int = PASSAGE, crowd: int = CROWD) -> DataFrame:
    """(id, spans): for each text of ``_texts`` that has any, the byte ranges covered by strings of ``length`` bytes, and
    those by strings of ``passage`` bytes (fewer or as many), that also start anywhere else; as array of (a, z, n), z
    exclusive, n the strings' bytes, not merged.

    1. Texts are cut into pieces by the anchors of strings of ``passage`` bytes; each piece goes on until the last of
       its strings would have ``length`` bytes, or to the text's end. Equal pieces are counted: a piece that occurs
       twice is repeated as a whole, and stands for all its copies from here on.
    2. Anchors with several different pieces are left; the bytes of one of each are fetched by a join.
    3. Pieces of an anchor are sorted column-wise in blocks of bounded size. Where an anchor has over ``crowd``
       different pieces, its starts are halved and dealt by a hash of the bytes that all strings of a half share, until
       no group is a crowd or its strings are equal; what is alone drops out.
    4. Ranges go back to all places of their pieces.
    """
    if not GRAM <= passage <= length <= NUMBER // 2:
        raise ValueError(f"strings have {GRAM} bytes at least and {NUMBER // 2} at most")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            out = []
            for t in as_bytes(batch.column("text")):
                out.append([{"gram": h, "hash": xxhash.xxh3_64_intdigest(t[a : z + length], (p - a) << 32 | (z - a)) - (1 << 63), "a": a, "pack": _pack(p - a, z - a, min(z + length, len(t)) - a)} for h, p, a, z in pieces(t, passage)])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("times"), pa.array(out, pa.list_(PIECE))], names=["id", "times", "pieces"])

    found = written(texts.select("id", "times", "text").mapInArrow(cut, "id long, times long, pieces array<struct<gram:long,hash:long,a:long,pack:long>>"), "pieces").where(F.size("pieces") > 0)
    each = found.select("id", "times", F.inline("pieces"))
    counted = written(each.groupBy("gram", "hash").agg(F.sum("times").alias("n"), F.min(F.struct("id", "a", "pack")).alias("one")), "piece-counts")
    several = written(counted.groupBy("gram").agg(F.count("*").alias("different")).where(F.col("different") > 1), "several-pieces")
    crowds = several.where(F.col("different") > crowd).select("gram")
    n_crowds = crowds.count()

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            rows: list[tuple] = []
            for t, ws in zip(as_bytes(batch.column("text")), batch.column("wanted").to_pylist(), strict=True):
                for w in ws:
                    place, last, end = _unpack(w["pack"])
                    rows.append((w["gram"], w["gram"], w["hash"], w["n"], -place, last - place, t[w["a"] : w["a"] + end]))
            kinds = [*[pa.int64()] * 4, pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["g", "gram", "hash", "n", "low", "high", "data"])

    def of(grams: DataFrame) -> DataFrame:
        """The pieces of some anchors, with their bytes."""
        chosen = counted.join(grams, "gram").select("one.id", F.struct("gram", "hash", "n", "one.a", "one.pack").alias("piece"))
        wanted = chosen.groupBy("id").agg(F.collect_list("piece").alias("wanted"))
        found = texts.select("id", "text").join(wanted.hint("merge"), "id").mapInArrow(fetch, "g long, gram long, hash long, n long, low int, high int, data binary")
        return found.withColumn("start", F.col("low"))

    # Joins are by sorting at every size: a plan that broadcasts while tables are small tells nothing of larger ones.
    rows = of(several.where(F.col("different") <= crowd).select("gram").hint("merge"))
    alike = None
    if n_crowds:  # few: each has over ``crowd`` pieces
        dealt, alike = _deal_out(written(of(F.broadcast(crowds) if n_crowds <= 100_000 else crowds).dropDuplicates(["gram", "hash"]), "crowd-pieces"), length, passage, crowd)
        rows = rows.unionByName(dealt)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            whole = pa.Table.from_batches(held).combine_chunks()
            g = whole["g"].to_numpy()
            keep = 0 if last else int(np.count_nonzero(g == g[-1]))  # the last group may go on
            head = whole.slice(0, len(g) - keep)
            held = whole.slice(len(g) - keep).to_batches() if keep else []
            if len(head):
                yield _sorted_block(head, [length, passage])

        for batch in batches:
            for at in range(0, batch.num_rows, SORTED):
                held.append(batch.slice(at, SORTED))
                if sum(b.num_rows for b in held) >= SORTED:
                    yield from done(False)
        if held:
            yield from done(True)

    by_sort = rows.repartition("g").sortWithinPartitions("g", "gram", "hash").mapInArrow(sort, RANGES)
    if alike is not None:
        by_sort = by_sort.unionByName(alike)
    last, end = F.shiftright("one.pack", 20).bitwiseAND(NUMBER), F.col("one.pack").bitwiseAND(NUMBER)
    # The bytes of a piece's strings to remove, if it has any, hold those of its shorter ones.
    span = F.when(end >= length, _span(F.lit(0), end - length, length)).otherwise(_span(F.lit(0), last, passage))
    whole = counted.where(F.col("n") > 1).select("gram", "hash", F.array(span).alias("spans"))
    decided = by_sort.unionByName(whole)
    back = each.join(decided.hint("merge"), ["gram", "hash"]).select("id", F.col("a").alias("at"), F.explode("spans").alias("s"))
    spans = back.select("id", _span(F.col("at") + F.col("s.a"), F.col("at") + F.col("s.z") + F.col("s.n"), F.col("s.n")).alias("span"))
    return spans.groupBy("id").agg(F.collect_list("span").alias("spans"))


def _pack(place: int, last: int, end: int) -> int:
    """A piece's anchor, last start and end, counted from its first byte, in one number."""
    return place << 40 | last << 20 | end


def _unpack(pack: int) -> tuple[int, int, int]:
    return pack >> 40, pack >> 20 & NUMBER, pack & NUMBER


def _span(a: Column, z: Column, n: Column | int) -> Column:
    return F.struct(a.cast("long").alias("a"), z.cast("long").alias("z"), (F.lit(n) if isinstance(n, int) else n).cast("long").alias("n"))


def _sorted_block(block: pa.Table, lengths: list[int]) -> pa.RecordBatch:
    """Ranges of the pieces that occur once, as starts from the piece's first byte."""
    frame = {n: block[n].to_numpy() for n in ("g", "gram", "hash", "n", "low", "high", "start")}
    distinct = np.append(True, (frame["g"][1:] != frame["g"][:-1]) | (frame["gram"][1:] != frame["gram"][:-1]) | (frame["hash"][1:] != frame["hash"][:-1]))
    at = np.flatnonzero(distinct)  # a text that came from several tasks was fetched as often
    data = block["data"].take(pa.array(at)).to_pylist()
    frame = {n: x[at] for n, x in frame.items()}
    groups = np.cumsum(np.append(False, frame["g"][1:] != frame["g"][:-1]))
    found = sort_columns(data, groups, frame["start"], lengths, frame["low"], frame["high"])
    kept = [k for k in range(len(data)) if frame["n"][k] == 1 and any(f[k] for f in found)]
    spans = [[{"a": a - int(frame["start"][k]), "z": z - int(frame["start"][k]), "n": n} for n, f in zip(lengths, found, strict=True) for a, z in f[k]] for k in kept]
    return pa.RecordBatch.from_arrays([pa.array(frame["gram"][kept]), pa.array(frame["hash"][kept]), pa.array(spans, SPANS)], names=["gram", "hash", "spans"])


def _deal_out(rows: DataFrame, length: int, passage: int, crowd: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose groups have at most ``crowd`` pieces, and the ranges of single starts at which crowds are equal.

    A group's strings start between its least and its greatest start. All those of the lower half hold the bytes from
    the middle to the end of the first, all those of the upper half those from the last start to the end of the middle.
    Where all strings of ``passage`` bytes are equal at one start, those of ``length`` bytes are counted by their md5.
    """
    ready, alike = [], []
    bound = rows.withColumn("least", F.lit(-(passage - GRAM))).withColumn("most", F.lit(0))
    narrowest = passage - GRAM + 1  # starts of a group, at least
    while True:
        crowds = F.broadcast(bound.groupBy("g").agg(F.count("*").alias("size")).where(F.col("size") > crowd).select("g"))  # at most rows / crowd
        ready.append(written(bound.join(crowds, "g", "left_anti").select(rows.columns), "crowd-ready"))
        large = written(bound.join(crowds, "g", "left_semi"), "crowd-left")
        forget(bound)
        if narrowest == 1:
            alike.append(_alike(large.where(F.col("least") == F.col("most")), length, passage))
        left = large.where(F.col("least") < F.col("most"))
        if left.limit(1).count() == 0:
            forget(large)
            return reduce(DataFrame.unionByName, ready), reduce(DataFrame.unionByName, alike) if alike else None
        middle = F.floor((F.col("least") + F.col("most")) / 2).cast("int")
        lower = left.select(*rows.columns, "least", middle.alias("most"))
        upper = left.select(*rows.columns, (middle + 1).alias("least"), "most")
        halves = lower.unionByName(upper)
        halves = halves.withColumn("low", F.greatest("low", "least")).withColumn("high", F.least("high", "most")).where(F.col("low") <= F.col("high"))
        shared = F.substring("data", F.col("most") - F.col("start") + 1, F.col("least") + passage - F.col("most"))
        bound = written(halves.withColumn("g", F.xxhash64("gram", "least", "most", shared)), "crowd-halves")
        forget(large)
        narrowest = max(1, narrowest // 2)


def _alike(rows: DataFrame, length: int, passage: int) -> DataFrame:
    """Ranges of pieces whose groups have one start and equal strings of ``passage`` bytes at it."""
    at = F.col("least") - F.col("start")
    data = F.substring("data", at + 1, F.lit(length))
    equal = rows.select("gram", "hash", "n", at.alias("at"), F.col("least").alias("place"), data.alias("data"))
    own = equal.where("n = 1").select("gram", "hash", F.array(_span(F.col("at"), F.col("at"), passage)).alias("spans"))
    whole = F.concat(F.encode(F.concat_ws(":", "gram", "place"), "utf-8"), F.lit(b":"), F.col("data"))
    long = written(equal.where(F.octet_length("data") == length).select("gram", "hash", "n", "at", F.unhex(F.md5(whole)).alias("sum")), "crowd-long")
    again = long.groupBy("sum").agg(F.count("*").alias("pieces")).where(F.col("pieces") > 1)
    longer = join_one(long, again, "sum").where("n = 1").select("gram", "hash", F.array(_span(F.col("at"), F.col("at"), length)).alias("spans"))
    return written(own.unionByName(longer), "crowd-alike")


def merged(spans: list[dict], least: int) -> list[tuple[int, int]]:
    """The ranges of strings of ``least`` bytes or more, without overlaps."""
    out: list[list[int]] = []
    for a, z in sorted((s["a"], s["z"]) for s in spans if s["n"] >= least):
        if out and a <= out[-1][1]:
            out[-1][1] = max(z, out[-1][1])
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


def _stripped(df: DataFrame, length: int, text: str, passage: int, crowd: int) -> DataFrame:
    """(key, left, cuts, repeated) of the texts that have repeats; a text that came from several tasks comes as often."""
    passage = min(passage, length)
    texts = _texts(df, text)
    spans = repeated_spans(texts, length, passage, crowd)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            out = []
            for t, s in zip(as_bytes(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
                cuts = merged(s, length)
                left = b"".join([t[a:z] for a, z in zip([0, *(z for _, z in cuts)], [*(a for a, _ in cuts), len(t)], strict=True)])
                out.append((left, len(cuts), sum(z - a for a, z in merged(s, passage))))
            kinds = [pa.binary(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array([x[i] for x in out], k) for i, k in enumerate(kinds))], names=["key", "left", "cuts", "repeated"])

    return texts.select("id", "key", "text").join(spans.hint("merge"), "id").mapInArrow(strip, "key binary, left binary, cuts long, repeated long")


def remove_repeats(df: DataFrame, length: int = 400, text: str = "text", passage: int = PASSAGE, crowd: int = CROWD) -> DataFrame:
    """``df`` with kept (binary: the bytes left), n_removed, n_spans and n_repeated (long).

    Texts are taken as UTF-8. Every byte covered by a string of ``length`` bytes that starts anywhere else too, in any
    text or the same, is removed; overlaps count, and strings are judged on the input. Those covered by such strings of
    ``passage`` bytes (``length`` at most) are counted in n_repeated and stay, unless they are removed. Null is an empty text. Copies are
    judged once and found by their md5, so one text may be a third of all rows. No rows give no rows. Input columns of
    these names are replaced.
    """
    made = ["kept", "n_removed", "n_spans", "n_repeated"]
    own = [c for c in df.columns if c not in made]
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.unhex(F.md5(whole)).alias("key"), whole.cast("binary").alias("whole"))
    kept = F.coalesce("left", "whole")
    found = join_one(rows, _stripped(df, length, text, passage, crowd).dropDuplicates(["key"]), "key", "left")
    return found.select("row.*", kept.alias("kept"), (F.octet_length("whole") - F.octet_length(kept)).cast("long").alias("n_removed"), F.coalesce("cuts", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("repeated", F.lit(0)).cast("long").alias("n_repeated"))


def op8_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document. Digests are made where the texts are, so that they need not meet the rows.

    n_repeated, beyond the contract: bytes in strings of PASSAGE bytes that start elsewhere too, so that repeated
    passages of some 50 words show, which are not long enough to be removed.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stripped = written(_stripped(docs, 400, "text", PASSAGE, CROWD).select("key", F.octet_length("left").alias("size"), F.sha2("left", 256).alias("sha"), "cuts", "repeated").distinct(), "stripped")
    whole = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.unhex(F.md5(whole)).alias("key"), F.octet_length(whole).cast("long").alias("n_bytes"), F.sha2(whole.cast("binary"), 256).alias("whole_sha"))
    found = join_one(written(rows, "digests"), stripped, "key", "left")
    left = F.coalesce("size", F.col("n_bytes"))
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - left).cast("long").alias("n_removed"), F.coalesce("cuts", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("sha", "whole_sha").alias("kept_sha256"), F.coalesce("repeated", F.lit(0)).cast("long").alias("n_repeated"))


ORACLE = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 800)) AS g FROM (SELECT doc_id, h, unnest(range(0, n - 399)) AS p FROM d WHERE n >= 400)),
r AS (SELECT doc_id, p FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM w) WHERE c > 1),
q AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM r),
k AS (SELECT doc_id, p, sum(CASE WHEN q IS NULL OR p > q + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM q),
m AS (SELECT doc_id, k, min(p) AS a, max(p) + 400 AS z FROM k GROUP BY 1, 2),
x AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS s, a AS e FROM m UNION ALL SELECT doc_id, max(z), NULL FROM m GROUP BY 1),
t AS (SELECT doc_id, string_agg(substr(h, 2 * s + 1, 2 * (coalesce(e, n) - s)), '' ORDER BY s) AS kh FROM x JOIN d USING (doc_id) GROUP BY 1),
g AS (SELECT doc_id, sum(z - a) AS gone, count(*) AS spans FROM m GROUP BY 1),
w2 AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, {2 * PASSAGE})) AS g FROM (SELECT doc_id, h, unnest(range(0, n - {PASSAGE - 1})) AS p FROM d WHERE n >= {PASSAGE})),
r2 AS (SELECT doc_id, p FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM w2) WHERE c > 1),
q2 AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM r2),
g2 AS (SELECT doc_id, sum(CASE WHEN q IS NULL THEN {PASSAGE} ELSE least(p - q, {PASSAGE}) END) AS held FROM q2 GROUP BY 1)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kh, h))) AS kept_sha256,
    CAST(coalesce(held, 0) AS BIGINT) AS n_repeated
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN g2 USING (doc_id)
"""
