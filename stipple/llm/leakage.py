"""Evaluation passages in a corpus: a prefix-filtered set join on five-word shingles, then containment word by word.

1. Items become tables of comparable words (see ``subtitles``) and of hashed five-word shingles. One pass reduces every
   document to comparable words and keeps the shingles that are among those of the items, with their places. No cue is
   left out: cues that may be without dialogue (sounds, songs, addresses) keep their words, and shingles are also taken
   across them. Documents without any item's shingle are done; the others are written once.
2. The number of documents with each shingle orders the shingles by rarity. A passage of ``run`` words has ``run - 4``
   shingles, of which damage may destroy all but ``keep``; so each window of ``run`` words of an item is joined by its
   ``run - 4 - keep + 1`` rarest shingles, its prefix. Frequent phrases drop out of the join.
3. Joined hits are bounded by position (hits of one passage lie on one diagonal, but for inserted words) and length, and
   containment is verified over a window of the item's size: in order, across cue breaks, words equal in their
   comparable form or, if long, one edit apart.

Scale: the corpus is read once, whatever the number of items, and no text is shuffled but those of documents that share
a prefix with an item. To read it, a task holds one filter of at most ``FILTER_BYTES``: all shingles' hashes while they
fit, else a bitmap of that size, whose false hits drop out in the join. Shingles, items and hits are tables; a shingle
of very many documents meets few items, so adaptive execution broadcasts the prefixes by measured size or splits it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stipple.llm import subtitles
from stipple.session import materialize, spread

WORDS = 5
#: Shingles of a passage that damage leaves; 1 joins by all of them.
KEEP = 3
#: Bytes of the filter of shingles that every task holds.
FILTER_BYTES = 32_000_000
#: Words by which hits of one passage may be off their diagonal for each word between them, and besides.
DRIFT, SLACK = 0.5, 12
#: Words of a cue that may stand in a passage without being part of it.
SHORT = 3

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_codes: dict[str, int] = {}


def _code(word: str) -> int:
    got = _codes.get(word)
    if got is None:
        if len(_codes) > 500_000:  # bounds a worker's memory
            _codes.clear()
        got = _codes[word] = xxhash.xxh64_intdigest(word)
    return got


def shingles(words: list[str]) -> np.ndarray:
    """The hashes of the five-word shingles of a list of words, by their first word."""
    if len(words) < WORDS:
        return np.zeros(0, dtype=np.int64)
    codes = np.fromiter(map(_code, words), dtype=np.uint64, count=len(words))
    n = len(words) - WORDS + 1
    out = np.zeros(n, dtype=np.uint64)
    for k in range(WORDS):
        out = (out ^ codes[k : k + n]) * _PRIME
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


class Filter:
    """Tells whether a hash may be among the items' shingles: by all hashes, or by one bit each where they are too many."""

    def __init__(self, hashes: np.ndarray | None, bits: np.ndarray | None) -> None:
        self.hashes, self.bits = hashes, bits

    @classmethod
    def of(cls, table: DataFrame, size: int) -> Filter:
        """Of the column h; at most ``size`` bytes come to the driver."""
        table = table.select("h").distinct()
        if table.count() * 8 <= size:
            return cls(np.sort(np.array([r["h"] for r in table.toLocalIterator()], dtype=np.int64)), None)
        # pages of 32,768 bits, which Spark's bitmaps have
        pages = max(1, size // 4096)
        at = F.pmod("h", F.lit(pages * 32768))
        rows = table.select(at.alias("b")).groupBy(F.bitmap_bucket_number("b").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits"))
        out = np.zeros((pages + 1, 4096), dtype=np.uint8)
        for r in rows.toLocalIterator():
            out[r["page"]] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
        return cls(None, out)

    def may_have(self, hashes: np.ndarray) -> np.ndarray:
        if self.hashes is not None:
            if not len(self.hashes):
                return np.zeros(len(hashes), dtype=bool)
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            return self.hashes[at] == hashes
        bit = hashes % ((len(self.bits) - 1) * 32768)
        # bucket numbers begin at 1, and a positive bit's position is its value less one
        page, within = np.where(bit > 0, 1 + (bit - 1) // 32768, bit // 32768), np.where(bit > 0, (bit - 1) % 32768, -bit % 32768)
        return (self.bits[page, within >> 3] >> (within & 7)) & 1 > 0


def _items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for ident, text in zip(pdf["item"], pdf["t"]):
            # a word that is empty where accents are lost may be absent from a document
            pairs = [(subtitles.fold(w), p) for w in text.split() if (p := subtitles.fold_plain(w))]
            if len(pairs) >= WORDS:
                out.append((ident, [a for a, _ in pairs], [b for _, b in pairs]))
        yield pd.DataFrame(out, columns=["item", "folded", "plain"])


def item_shingles(folded: list[str], plain: list[str]) -> set[tuple[int, int, int]]:
    """(hash, from, to) of an item's shingles, with accented letters lost or plain; words that are empty without accents are passed over."""
    kept = [i for i, w in enumerate(folded) if w]
    lost = shingles([folded[i] for i in kept]).tolist()
    out = {(h, kept[k], kept[k + WORDS - 1] + 1) for k, h in enumerate(lost)}
    return out | {(h, i, i + WORDS) for i, h in enumerate(shingles(plain).tolist())}


def prefixes(own: Sequence[tuple[int, int, int]], count: dict[int, int], n_words: int, run: int, keep: int) -> set[tuple[int, int, int]]:
    """Those of an item's shingles (hash, from, to) that join: in each window of the run's size the rarest ones."""
    by_start: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for h, i, to in own:
        by_start[i].append((h, to))
    n = min(run, n_words) - WORDS + 1
    rank = {i: min((count.get(h, 0), h) for h, _ in places) for i, places in by_start.items()}
    out = set()
    for at in range(max(1, n_words - run + 1)):
        window = sorted((i for i in range(at, at + n) if i in rank), key=rank.__getitem__)
        for i in window[: max(1, n - keep + 1)]:
            out.update((h, i, to) for h, to in by_start[i])
    return out


def _shingle_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(ident, len(f), *s) for ident, f, p in zip(pdf["item"], pdf["folded"], pdf["plain"]) for s in sorted(item_shingles(list(f), list(p)))]
        yield pd.DataFrame(rows, columns=["item", "n_words", "h", "i", "j"])


def _chosen(run: int, keep: int):
    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        own = list(zip(pdf["h"].tolist(), pdf["i"].tolist(), pdf["j"].tolist()))
        rows = prefixes(own, dict(zip(pdf["h"].tolist(), pdf["n"].tolist())), int(pdf["n_words"].iloc[0]), run, keep)
        return pd.DataFrame([(pdf["item"].iloc[0], *r) for r in sorted(rows)], columns=["item", "h", "i", "j"])

    return choose


def near_equal(a: str, b: str) -> bool:
    """Equal, or one edit apart if long."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 4:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def longest(item: list[str], plain: list[str], words: list[str], cue: list[int], beside: set[int], seed: tuple[int, int, int, int]) -> tuple[int, int]:
    """The words of the item, from place to place, that the document has in order around a shared shingle (from, to, and where it stands in the document, from and to).

    Two words of the document may be one of the item and the reverse. The cues ``beside`` the dialogue and those of at most
    ``SHORT`` words (sounds whose brackets were lost) may stand between two cues of the passage.
    """

    def same(i: int, w: str) -> bool:
        return near_equal(item[i], w) or (plain[i] != item[i] and near_equal(plain[i], w))

    def walk(i: int, q: int, step: int) -> int:
        """The last matched place of the item when going on from (i, q), neither of which is matched yet."""
        last = i - step
        while 0 <= i < len(item) and 0 <= q < len(words):
            q2, i2 = q + step, i + step
            if same(i, words[q]):
                last, i, q = i, i2, q2
            elif not item[i]:
                i = i2
            elif 0 <= q2 < len(words) and same(i, words[min(q, q2)] + words[max(q, q2)]):
                last, i, q = i, i2, q2 + step
            elif 0 <= i2 < len(item) and any(f[min(i, i2)] + f[max(i, i2)] == words[q] for f in (item, plain)):
                last, i, q = i2, i2 + step, q2
            elif cue[q] != cue[q - step]:
                own, at = cue[q], q
                while 0 <= q < len(words) and cue[q] == own:
                    q += step
                if own not in beside and abs(q - at) > SHORT:
                    break
            else:
                break
        return last

    i, to, q, end = seed
    return walk(i - 1, q - 1, -1), walk(to, end, 1)


def _batch(rows: list[tuple], *fields: tuple[str, pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


def _read(own: Filter, phrases: tuple[str, ...]):
    def hits(words: list[str], cue: list[int], beside: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, from, to) of the shingles that may be an item's: in a row, and across the cues beside the dialogue."""
        h = shingles(words)
        at = np.flatnonzero(own.may_have(h))
        found = [(h[at], at, at + WORDS)]
        if beside:
            kept = np.flatnonzero(~np.isin(cue, beside))
            h = shingles([words[k] for k in kept])
            if len(h):
                first, last = kept[: len(h)], kept[WORDS - 1 :]
                k = np.flatnonzero((last - first >= WORDS) & own.may_have(h))
                found.append((h[k], first[k], last[k] + 1))
        return tuple(np.concatenate(c) for c in zip(*found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text in zip(*(batch.column(c).to_pylist() for c in ("doc", "text"))):
                words, cue, beside = subtitles.dialogue(text, phrases)
                h, q, end = hits(words, cue, beside)
                if len(h):
                    out.append((doc, h.tolist(), q.tolist(), end.tolist(), " ".join(words), np.diff(cue, prepend=0).astype(np.int32).tobytes(), beside))
            numbers = pa.list_(pa.int32())
            yield _batch(out, ("doc", batch.schema.field("doc").type), ("h", pa.list_(pa.int64())), ("q", numbers), ("end", numbers), ("words", pa.string()), ("steps", pa.binary()), ("beside", numbers))

    return run


def _verify(run: int):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = words = cue = between = None
        for batch in batches:
            out = []
            names = ("doc", "item", "words", "steps", "beside", "folded", "plain", "seeds")
            for doc, ident, text, steps, beside, item, plain, seeds in zip(*(batch.column(c).to_pylist() for c in names)):
                if doc != held:  # the rows of a document follow each other
                    held, words, cue, between = doc, text.split(" "), np.cumsum(np.frombuffer(steps, dtype=np.int32)).tolist(), set(beside)
                need = min(run, len(item))
                if len(words) * 2 < need:  # length: joined words halve them at most
                    continue
                best = (0, 0, 0)
                done: list[tuple[int, int, int]] = []
                for q, end, i, to in sorted((z["q"], z["end"], z["i"], z["j"]) for z in seeds):
                    # position: a hit on the diagonal of a verified passage adds nothing
                    if any(a <= i <= b and abs(q - i - d) <= SLACK + DRIFT * (b - a) and b - a + 1 >= need for a, b, d in done):
                        continue
                    # the hash decides nothing: the words are compared
                    own = words[q:end] if end - q == WORDS else [words[k] for k in range(q, end) if cue[k] not in between]
                    if own != plain[i:to] and own != [w for w in item[i:to] if w]:
                        continue
                    a, b = longest(item, plain, words, cue, between, (i, to, q, end))
                    done.append((a, b, q - i))
                    best = max(best, (b - a + 1, a, b))
                if best[0] >= need:
                    out.append((doc, ident, *best))
            yield _batch(out, ("doc", batch.schema.field("doc").type), ("item", pa.int64()), *((c, pa.int32()) for c in ("n_words", "first_word", "last_word")))

    return check


def leaks(
    docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", run: int = 14, keep: int = KEEP, phrases: Sequence[str] = (), filter_bytes: int = FILTER_BYTES
) -> DataFrame:
    """doc_id, item_id, n_words, first_word, last_word: documents with an item or ``run`` consecutive words of it.

    The longest passage counts, by the item's words from 0. ``keep`` is the number of whole shingles a passage must have;
    with 1 all shingles join. Cues that begin with any of ``phrases`` (credits, adverts) may stand within a passage. Items
    of fewer than five words, null and empty texts on either side give no rows; ids must be unique and not null. Other
    columns are ignored, equal texts are judged alike.
    """
    if not 1 <= keep <= run - WORDS + 1:
        raise ValueError("keep must be from 1 to the shingles of a run")
    texts = items.filter(F.col(item_text).isNotNull() & F.col(item_id).isNotNull()).select(F.col(item_id).cast("long").alias("item"), F.col(item_text).alias("t"))
    held = materialize(texts.mapInPandas(_items, "item long, folded array<string>, plain array<string>"))
    places = materialize(held.mapInPandas(_shingle_rows, "item long, n_words int, h long, i int, j int"))
    whole = docs.filter(F.col(text).isNotNull() & (F.length(text) > 0)).select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    kind = dict(whole.dtypes)["doc"]
    read = _read(Filter.of(places, filter_bytes), subtitles.forms(phrases))
    hits = materialize(spread(whole).mapInArrow(read, f"doc {kind}, h array<long>, q array<int>, end array<int>, words string, steps binary, beside array<int>"))
    per = hits.select(F.explode(F.array_distinct("h")).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    ranked = places.join(per, "h", "left").na.fill(0, ["n"])
    # written, as the seeds below: their sizes are then known, and few of them reach the hits and texts without a shuffle
    prefix = materialize(ranked.groupBy("item").applyInPandas(_chosen(run, keep), "item long, h long, i int, j int"))
    seeds = hits.select("doc", F.explode(F.arrays_zip("h", "q", "end")).alias("z")).select("doc", "z.*").join(prefix, "h")
    seeds = materialize(seeds.groupBy("doc", "item").agg(F.collect_list(F.struct("q", "end", "i", "j")).alias("seeds")))  # at most a text's places
    pairs = hits.select("doc", "words", "steps", "beside").join(seeds, "doc").join(held, "item")
    found = pairs.mapInArrow(_verify(run), f"doc {kind}, item long, n_words int, first_word int, last_word int")
    return found.withColumnsRenamed({"doc": doc_id, "item": item_id})


def leaked_items(found: DataFrame, items: DataFrame, *, item_id: str = "item_id") -> DataFrame:
    """Per item: the number of documents that leak it, 0 included."""
    counts = found.groupBy(item_id).agg(F.count(F.lit(1)).alias("n_docs"))
    return items.select(item_id).join(counts, item_id, "left").select(item_id, F.coalesce("n_docs", F.lit(0)).alias("n_docs"))
