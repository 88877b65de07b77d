"""Byte-pair encoding and decoding with a given vocabulary, by an index of pair occurrences."""

from __future__ import annotations

import contextlib
import gc
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import slices, table

#: Unicode's White_Space, as the tokenizer's patterns mean it.
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else the next free one from U+0100."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


@contextlib.contextmanager
def no_cycles() -> Iterator[None]:
    """Many small lists, none in a cycle: the collector would go through all of them again and again."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


class WordBpe:
    """A tokenizer file of kind BPE with word ends, normaliser NFC, white space, lower case, and no decoder.

    Distinct words of a batch are laid out in one sequence of symbols. ``merge`` indexes every pair's positions and
    applies the merges in ascending rank. Words already met are kept, up to ``keep`` of them at a time.
    """

    def __init__(self, source: str, keep: int = 200_000) -> None:
        file = json.loads(source)
        model, kinds = file["model"], [x["type"] for x in (file["normalizer"] or {}).get("normalizers", [])]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or file["decoder"] or file["post_processor"] or model["continuing_subword_prefix"]:
            raise ValueError("this tokenizer file has parts that are not known here")
        self.ids: dict[str, int] = model["vocab"]
        pairs = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in model["merges"]]
        self.merges = [(self.ids[a], self.ids[b], self.ids[a + b]) for a, b in pairs]
        codes = np.array([a << 32 | b for a, b, _ in self.merges], np.int64)
        self.pair_ranks = np.argsort(codes)
        self.pair_codes = codes[self.pair_ranks]
        made: dict[str, int] = {a + b: r for r, (a, b) in enumerate(pairs)}
        if any(made.get(x, -1) > r for r, ab in enumerate(pairs) for x in ab):
            raise ValueError("a merge comes before the one that makes its part; ascending order would not be exact")
        self.end: str = model["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in file["added_tokens"]}
        names = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        spelt = [names.get(i, "").encode() + b" " for i in range(max(names) + 1)]
        self.name_bytes = np.frombuffer(b"".join(spelt), np.uint8)
        self.name_size = np.array([len(x) for x in spelt])
        self.name_at = np.cumsum(self.name_size) - self.name_size
        split = next(x for x in file["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"].replace(r"\s", SPACE))
        self.marks = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.chunks = regex.compile(f"[^{SPACE}]+")
        self.of_byte = np.array([self.ids.get(x, -1) for x in byte_letters()], np.int64)
        self.of_last_byte = np.array([self.ids.get(x + self.end, -1) for x in byte_letters()], np.int64)
        self.more_space = regex.compile("[\x1c-\x1f]")
        self.keep: int = keep
        self.known: dict[str, bytes] = {}

    def pieces(self, chunk: str) -> list[str | int]:
        """The words of a run without white space, and the ids of special tokens in it."""
        if chunk.isascii() and chunk.isalpha():
            return [chunk.lower()]
        out: list[str | int] = []
        at = 0
        for m in self.marks.finditer(chunk) if self.marks else ():
            out += [*self._words(chunk[at : m.start()]), self.special[m[0]]]
            at = m.end()
        return out + self._words(chunk[at:])

    def _words(self, part: str) -> list[str]:
        if part.isascii():
            return self.words.findall(part.lower())
        whole = unicodedata.normalize("NFC", part)
        # Letter by letter: alone, a capital sigma has one lower-case form; it is the only letter that looks around.
        return self.words.findall("".join(c.lower() for c in whole) if "Σ" in whole else whole.lower())

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, -1 where no merge takes them."""
        codes = (left.astype(np.int64) << 32) | right
        at = np.searchsorted(self.pair_codes, codes)
        at[at == len(self.pair_codes)] = 0
        return np.where((self.pair_codes[at] == codes) & (left >= 0) & (right >= 0), self.pair_ranks[at], -1)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and the place where each word's ids end.

        ``index`` holds for each rank the positions of its pair; ``active`` the ranks that have positions.
        """
        coded = [w.encode() for w in words]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        text = np.frombuffer(b"".join(coded), np.uint8)
        word = np.repeat(np.arange(len(words)), sizes)
        sym = self.of_byte[text]
        ends = np.cumsum(sizes) - 1
        sym[ends] = self.of_last_byte[text[ends]]
        sym, word = sym[sym >= 0], word[sym >= 0]
        sym = np.append(sym, -1)  # no pair begins at the last symbol of a word, nor at this one
        n = len(sym)
        after = np.arange(1, n + 1)
        before = np.arange(-1, n - 1)
        same = word[1:] == word[:-1]
        last, first = np.append(np.flatnonzero(~same), n - 2), np.append(0, np.flatnonzero(~same) + 1)
        if n > 1:
            after[last], before[first] = n - 1, n - 1
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(at: np.ndarray, found: np.ndarray) -> None:
            at, found = at[found >= 0], found[found >= 0]
            if not len(at):
                return
            order = np.argsort(found, kind="stable")
            at, found = at[order], found[order]
            cuts = np.flatnonzero(np.diff(found)) + 1
            for r, part in zip(found[np.append(0, cuts)].tolist(), np.split(at, cuts), strict=True):
                if r not in index:
                    index[r] = []
                    heapq.heappush(active, r)
                index[r].append(part)

        if n > 1:
            add(np.arange(n - 1), self.ranks(sym[:-1], sym[after[:-1]]))
        while active:
            r = heapq.heappop(active)
            a, b, into = self.merges[r]
            i = np.unique(np.concatenate(found)) if len(found := index.pop(r)) > 1 else found[0]
            i = i[(sym[i] == a) & (sym[after[i]] == b)]  # an earlier merge may have taken a part
            if a == b and len(i) > 1:  # of runs of one symbol, take every other pair from the left
                kept, taken = [], -1
                for x, y in zip(i.tolist(), after[i].tolist(), strict=True):
                    if x != taken:
                        kept.append(x)
                        taken = y
                i = np.array(kept)
            if not len(i):
                continue
            j = after[i]
            sym[i], sym[j] = into, -2
            k = after[i] = after[j]
            inside = k < n - 1
            before[k[inside]] = i[inside]
            h = before[i]
            h = h[h < n - 1]
            add(np.concatenate([i, h]), self.ranks(np.concatenate([sym[i], sym[h]]), sym[np.concatenate([after[i], after[h]])]))
        left = sym[:-1] >= 0
        return sym[:-1][left].astype("<u4"), np.searchsorted(word[left], np.arange(len(words)), side="right")

    def learn(self, chunks: Iterable[str]) -> None:
        """Make the ids of all chunks known."""
        wanted = set(chunks)
        missing = wanted.difference(self.known)
        if len(self.known) + len(missing) > self.keep:
            self.known.clear()
            missing = wanted
        new = {c: self.pieces(c) for c in missing}
        words = list({w for ps in new.values() for w in ps if isinstance(w, str)})
        ids, ends = self.merge(words)
        flat, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
        of = {w: flat[a:z] for w, a, z in zip(words, cuts, cuts[1:], strict=False)}
        for c, ps in new.items():
            self.known[c] = of[ps[0]] if len(ps) == 1 and isinstance(ps[0], str) else b"".join([p.to_bytes(4, "little") if isinstance(p, int) else of[p] for p in ps])

    def cut(self, text: str) -> list[str]:
        """The runs without white space. str.split takes four separators more, so it serves for texts without them."""
        return self.chunks.findall(text) if self.more_space.search(text) else text.split()

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        cut = [self.cut(t) for t in texts]
        with no_cycles():
            self.learn(c for cs in cut for c in cs)
        get = self.known.__getitem__
        return [b"".join(map(get, cs)) for cs in cut]

    def decode(self, coded: list[bytes]) -> list[bytes]:
        """The text of each sequence of ids as the library gives it without a decoder: tokens joined by a space."""
        ids = np.frombuffer(b"".join(coded), "<u4")
        size = self.name_size[ids]
        ends = np.cumsum(size)
        take = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.name_at[ids] - (ends - size), size)
        text, at, out = self.name_bytes[take].tobytes(), 0, []
        for end in np.cumsum([len(c) // 4 for c in coded]).tolist():
            stop = int(ends[end - 1]) if end else 0
            out.append(text[at : stop - (stop > at)])  # without the last token's space
            at = stop
        return out


_OPEN: dict[str, WordBpe] = {}


def opened(source: str) -> WordBpe:
    """One tokenizer for each Python worker."""
    key = hashlib.md5(source.encode()).hexdigest()
    if key not in _OPEN:
        _OPEN.clear()
        _OPEN[key] = WordBpe(source)
    return _OPEN[key]


def encode_texts(df: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """``df`` with ``ids`` (binary: little-endian unsigned 32-bit integers) and ``decoded`` (string).

    ``tokenizer`` is the path of a tokenizer file on the driver; its content, a few MB, goes to the workers. Null text
    counts as empty and gives no ids. Rows are independent: copies, ties and empty tables need nothing special. Very
    long texts are handled whole, in batches of bounded bytes. Input columns named ids or decoded are replaced.
    """
    with open(tokenizer, encoding="utf-8") as f:
        source = df.sparkSession.sparkContext.broadcast(f.read())
    own = [c for c in df.columns if c not in ("ids", "decoded")]
    kept = df.select(*[f"`{c}`" for c in own])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), "ids binary, decoded string"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = opened(source.value)
        for batch in slices(batches, text, 1 << 20):
            ids = bpe.encode([t or "" for t in batch.column(text).to_pylist()])
            decoded = pa.array(bpe.decode(ids), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary()), decoded], names=[*own, "ids", "decoded"])
        bpe.known.clear()  # the worker lives on and other stages need its memory

    return kept.mapInArrow(work, schema)


def op7_bpe_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of their decoding. Null text: no tokens, digests of nothing."""
    import public_tokenizers
    from pyspark.sql import functions as F

    found = encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
