"""Subtitle files that were cut off: self-joins by prefix of whole dialogues, cue heads, words and cues, and signs beside them.

One pass reads every file to its end; it writes the dialogue and what the end shows, and counts complete words and the
shapes of complete cue heads (number and time lines, their digits alike). Then the ends are joined:

1. A dialogue that is a strict prefix of a longer copy, found among the sorted dialogues: the copy goes on in the same
   cue, so the end was a cut, or in a new one only, so the last cue is complete.
2. A last line that is a strict prefix of cue heads: it stops inside a number or time line, or before any text.
3. A last word that is a strict prefix of longer words elsewhere and hardly ever stands alone.
4. A last cue that is a strict prefix of longer cues elsewhere and stands nowhere alone.

Values of every length take part. Where a file has no copy, signs that need none decide, and are named apart: a
character broken in its bytes, a speaker's dash without a word, a length at which the files of its source pile up (in
characters or bytes, or at multiples of a block size), a sentence left open in a file that closes its sentences, a word
that never ends a cue. Marks of an author (trailing off, interruption, sounds, songs) close a file, but not at its
source's limit where the source adds dots itself; a last cue that many files have is complete.

Scale: texts are read once and their dialogue is written once. Dialogues that share an opening with another one are
sorted by range and each is compared with what follows it; of a group of copies a task holds the open prefixes alone.
Words and cues are hashed only at the lengths that open ends with the same first characters have. The other shuffles
carry counters, pre-aggregated by task. The table of ends has one small row a file; the sides it joins are one counter a
key, written first, so they are broadcast by their size or adaptive execution splits the skewed files. The driver holds
the plan of one step at a time and the first RANGE characters of sampled dialogues.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stipple.llm import subtitles
from stipple.session import materialize, spread

#: Counters a task holds before it passes them on.
HELD = 300_000
#: Words of an opening that dialogues must share to be compared; shorter ones are compared with all openings.
OPENING = 8
#: Characters by which long values meet; shorter ones meet the first KEY characters of all.
KEY = 12
#: Characters by which sorted values are divided into ranges; samples of them reach the driver.
RANGE = 64
#: Share of closed cues from which a file counts as one that closes its sentences.
CLOSES = 0.2
#: Lengths pile up where at least PILE files have one, and TIMES as many as lengths within WINDOW have on average.
PILE, TIMES, WINDOW = 4, 8, 40
#: Sizes of blocks at whose multiples a transfer may end (fixed values).
BLOCKS = (*(2**k for k in range(7, 17)), 500, 1000, 2000, 5000, 10_000, 20_000, 50_000, 100_000)
#: A last cue that so many different files have is complete, if it isn't rare beside its continuations.
TAILS, TAIL_SHARE = 4, 0.2
#: A word that ends a cue less often than this in FREQUENT occurrences doesn't end one; one seen this rarely beside longer words is a part.
ENDS, FREQUENT, PART = 0.01, 100, 0.02
#: A word that ends a cue at least this often may end any.
ENDS_CUE = 0.05

_TRAIL = re.compile(r"(?:\.\.+|…|--+|[-–—―]|â€¦|â€”|â€“|Ã¢â‚¬Â¦|Ã¢â‚¬â€.?)[\s\"'»”’*_]*$")
#: A speaker's dash without any word behind it: alone on a line, or behind a closed sentence. No author ends a cue so.
_DASH = r"(?:[-–—―]|â€”|â€“)[\s\"'«“‘¿¡]*$"
_LONE_DASH, _NEXT_DASH = re.compile("^" + _DASH), re.compile(r"[.!?…)\]♪\"»”]\s+" + _DASH)
_STOP = re.compile(r"[.!?\])}♪♫#*]['\"»”’*_]*$|â™ª$|Ã¢â„¢Âª$")
_SENTENCE = re.compile(r"[.!?…]['\"»”’]*$")
#: What a number line or time line consists of.
_HEAD = re.compile(r"[0-9][0-9:.,\->\s]*")
_DIGITS = str.maketrans("123456789", "0" * 9)

_ENDS = (
    "key string, total long, ends long, doc {kind}, source string, n_chars long, n_bytes long, broken boolean, turn boolean, trail boolean, stop boolean, closes double, "
    "head string, word string, cue string, aside boolean, credit boolean, print long, opening long, body string, halts array<int>, asides string"
)


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def _body(all_cues: list[subtitles.Cue]) -> tuple[str, list[int], int]:
    """The dialogue, its cues ended by a line feed or, where a mark closes them, a carriage return; places where sentences end or trail off; its words."""
    parts, halts, at, n_words = [], [], 0, 0
    for cue in all_cues:
        if cue.aside or cue.credit or not cue.words:
            continue
        raw: list[str] = []
        for word in " ".join(cue.lines).split():
            if subtitles.fold(word):
                raw.append(word)
            elif raw:
                raw[-1] += " " + word  # a mark apart from its word
        raw = raw[-len(cue.words) :]  # without a speaker's label
        end = at - 1
        for folded, word in zip(cue.words, raw):
            end += len(folded) + 1
            if not word[-1].isalnum() and (_STOP.search(word) or _TRAIL.search(word)) and subtitles.fold(word.split()[0]) == folded:
                halts.append(end)
        text = " ".join(cue.words)
        at += len(text) + 1
        n_words += len(cue.words)
        parts += [text, "\r" if halts and halts[-1] == at - 1 else "\n"]
    return "".join(parts[:-1]), halts, n_words


def _heads(lines: list[str], heads: Counter) -> str | None:
    """Counts the shapes of complete cue heads, and gives the shape of one that the last line stops in or right behind.

    A number is '#', every digit of a time is 0, and a complete head ends in a line feed: text follows.
    """
    for k, line in enumerate(lines):
        if "->" in line and k + 1 < len(lines) and lines[k + 1].strip():
            shape = line.strip().translate(_DIGITS)
            if _HEAD.fullmatch(shape):
                heads[shape + "\n"] += 1
                if k and lines[k - 1].strip().isdigit():
                    heads["#\n" + shape + "\n"] += 1
    last, before = lines[-1].strip(), lines[-2].strip() if len(lines) > 1 else ""
    if last.isdigit() and not before:
        return "#"
    if _HEAD.fullmatch(last) and ":" in last and (not before or before.isdigit()):
        return ("#\n" if before else "") + last.translate(_DIGITS)
    return None


def _ending(text: str, phrases: tuple[str, ...], words: Counter, ends: Counter, heads: Counter) -> tuple | None:
    """What the end of a text shows; counts its complete words and cue heads. None for a blank text."""
    bare = text.rstrip()
    if not bare:
        return None
    cut = text.rstrip("\r\n")
    lines = bare.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    head = _heads(lines, heads)
    all_cues = subtitles.cues(text, phrases)
    closed = spoken = 0
    for cue in all_cues[:-1]:
        folded = cue.words
        if folded and not cue.aside and not cue.credit and not cue.music:
            spoken += 1
            closed += bool(_SENTENCE.search(cue.lines[-1]))
            words.update(folded)
            ends[folded[-1]] += 1
    tail = all_cues[-1]
    joined = " ".join(tail.lines)
    folded = tail.words
    words.update(folded[:-1])
    said = all_cues
    if head:  # the next cue's number and times are no words of the last one
        while lines and _HEAD.fullmatch(lines[-1].strip() or "0"):
            lines.pop()
        said = subtitles.cues("\n".join(lines), phrases)
    body, halts, n_words = _body(said)
    opening = _hash(" ".join(body.split(None, OPENING)[:OPENING])) if n_words > OPENING else None
    turn = bool(tail.lines) and bool(_LONE_DASH.search(tail.lines[-1]) or _NEXT_DASH.search(joined))
    music_open = tail.music and not re.search(r"(?:[♪♫#]|â™ª|Ã¢â„¢Âª)\W*$", joined)
    stop = bool(_STOP.search(joined)) and not music_open
    return (
        len(cut), len(cut.encode()), bare.endswith("\ufffd"), turn, bool(_TRAIL.search(joined)), stop, closed / spoken if spoken else -1.0,
        head, folded[-1] if folded else "", " ".join(folded), tail.aside and not music_open, tail.credit, _hash(text), opening, body, halts,
        "\n".join(" ".join(c.words) for c in said[:-1] if (c.aside or c.credit) and c.words),
    )


_COUNTERS = (("key", pa.string()), ("total", pa.int64()), ("ends", pa.int64()))
_SIGNS = (
    ("n_chars", pa.int64()), ("n_bytes", pa.int64()), ("broken", pa.bool_()), ("turn", pa.bool_()), ("trail", pa.bool_()), ("stop", pa.bool_()), ("closes", pa.float64()),
    ("head", pa.string()), ("word", pa.string()), ("cue", pa.string()), ("aside", pa.bool_()), ("credit", pa.bool_()), ("print", pa.int64()), ("opening", pa.int64()), ("body", pa.string()),
    ("halts", pa.list_(pa.int32())), ("asides", pa.string()),
)


def _read(phrases: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ends, heads = Counter(), Counter(), Counter()
        schema = None

        def table(rows: list[tuple], first: int) -> pa.RecordBatch:
            """Rows that begin at a column; the others are null."""
            columns = list(zip(*rows)) if rows else [()] * len(schema)
            arrays = []
            for i, f in enumerate(schema):
                own = rows and first <= i < first + len(rows[0])
                arrays.append(pa.array(columns[i - first], f.type) if own else pa.nulls(len(rows), f.type))
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        def counters() -> pa.RecordBatch:
            rows = [("w " + k, n, ends.get(k, 0)) for k, n in words.items()] + [("h " + k, n, n) for k, n in heads.items()]
            for c in (words, ends, heads):
                c.clear()
            return table(rows, 0)

        for batch in batches:
            if schema is None:
                schema = pa.schema([*_COUNTERS, ("doc", batch.schema.field("doc").type), ("source", pa.string()), *_SIGNS])
            doc, source, text = (batch.column(c).to_pylist() for c in ("doc", "source", "text"))
            yield table([(d, s, *e) for d, s, t in zip(doc, source, text) if (e := _ending(t, phrases, words, ends, heads))], len(_COUNTERS))
            if len(words) + len(heads) > HELD:
                yield counters()
        if words or heads:
            yield counters()

    return run


def _lengths(docs: DataFrame) -> DataFrame:
    """source, unit, n, files: how many different files of a source have a length in characters (c) or bytes (b)."""
    units = F.explode(F.array(F.struct(F.lit("c").alias("unit"), F.col("n_chars").alias("n")), F.struct(F.lit("b").alias("unit"), F.col("n_bytes").alias("n"))))
    # copies of one file are no pile
    own = docs.select("source", "n_chars", "n_bytes", "print").distinct()
    return own.select("source", units.alias("u")).groupBy("source", "u.unit", "u.n").agg(F.count(F.lit(1)).alias("files"))


def _limits(counts: DataFrame) -> DataFrame:
    """source, unit, n: lengths at which a source's files pile up."""
    # the neighbourhood by buckets of WINDOW lengths, each reaching the two beside it: no window over a whole source
    bucket = F.floor(F.col("n") / WINDOW)
    near = counts.select("source", "unit", F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"), "files")
    near = near.groupBy("source", "unit", "bucket").agg(F.sum("files").alias("around"))
    joined = counts.withColumn("bucket", bucket).join(near, ["source", "unit", "bucket"])
    mean = (F.col("around") - F.col("files")) / (3 * WINDOW)
    piles = joined.filter((F.col("files") >= PILE) & (F.col("files") >= TIMES * (mean + 0.2)) & (F.col("n") >= 100))
    return piles.select("source", "unit", "n")


def _blocks(counts: DataFrame) -> DataFrame:
    """source, c_blocks, b_blocks: sizes at whose multiples, however rare each of them, the lengths of a source's files pile up.

    Multiples of a larger size are left to that size, and the most frequent length doesn't count, as it is a limit alone.
    At least three lengths must show a size.
    """
    at = F.explode(F.array(*map(F.lit, BLOCKS))).alias("block")
    near = counts.select("source", "unit", "n", "files", at).withColumn("off", F.pmod(F.col("n") + WINDOW, F.col("block")) - WINDOW)
    own = F.lit(True)
    for b in BLOCKS:
        own = own & ((F.col("block") >= b) | (F.lit(b) % F.col("block") != 0) | ((F.col("n") - F.col("off")) % b != 0))
    near = near.filter((F.col("off") <= WINDOW) & (F.col("n") - F.col("off") >= F.col("block")) & own)
    hit = F.when(F.col("off") == 0, F.col("files"))
    sums = near.groupBy("source", "unit", "block").agg(
        (F.sum(hit) - F.max(hit)).alias("others"), F.count(hit).alias("lengths"), (F.sum(F.when(F.col("off") != 0, F.col("files")).otherwise(0)) / (2 * WINDOW)).alias("mean")
    )
    sizes = sums.filter((F.col("lengths") >= 3) & (F.col("others") >= PILE) & (F.col("others") >= TIMES * (F.col("mean") + 0.2)))
    of = lambda unit: F.collect_set(F.when(F.col("unit") == unit, F.col("block")))
    return sizes.groupBy("source").agg(of("c").alias("c_blocks"), of("b").alias("b_blocks"))


def length_limits(docs: DataFrame, *, text: str = "text", source: str = "source") -> DataFrame:
    """source, unit, n: lengths at which the files of a source pile up, in characters (c) or bytes (b), without their last line ends.

    Null and blank texts, and those without a source, take no part; equal texts of a source count once. An empty table gives
    no rows.
    """
    cut = F.regexp_replace(F.col(text), r"[\r\n]++\z", "")
    own = docs.filter(F.col(text).rlike(r"\S")).select(F.col(source).alias("source"), F.length(cut).cast("long").alias("n_chars"), F.octet_length(cut).cast("long").alias("n_bytes"), F.xxhash64(text).alias("print"))
    return _limits(_lengths(own))


def _plain(body: Column) -> Column:
    """A dialogue without the ends of its cues."""
    return F.replace(F.replace(body, F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(" "))


def strict_prefixes(bodies: DataFrame) -> DataFrame:
    """The distinct ``value`` that are strict prefixes, by characters, of another one, and how those go on.

    Values are the dialogues ``body`` with cue ends and ``halts``, the places where sentences end: in_word, in_cue (with
    a new word), new_cue tell how any next longer value goes on, halted that one ends a sentence there. Null and empty
    values take no part.

    In byte order, a value's continuations follow it at once. The values are sorted by range, copies apart, and every
    task walks its own with the prefixes still open; the last value of a range meets the first of the next one. Values with
    the same first RANGE characters are in one range, whose sort may spill; none but the open prefixes are held.
    """
    own = bodies.filter(F.length("body") > 0).groupBy(_plain(F.col("body")).alias("value")).agg(F.min(F.struct("body", "halts")).alias("_b")).select("value", "_b.*")
    flags = ("in_word", "in_cue", "new_cue", "halted")
    types = (pa.string(), *[pa.bool_()] * 4, pa.int32(), pa.string(), pa.list_(pa.int32()))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, stack, first, last = TaskContext.get().partitionId(), [], None, None
        table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * len(types), types)], names=["value", *flags, "part", "body", "halts"])
        for batch in batches:
            out = []
            for value, body, halts in zip(*(batch.column(c).to_pylist() for c in ("value", "body", "halts"))):
                first = first or (value, *[None] * 4, part, body, halts)
                while stack and not value.startswith(stack[-1][0]):
                    above, found = stack.pop()
                    if any(found):
                        out.append((above, *found, None, None, None))
                if stack:
                    n = len(stack[-1][0])
                    blank, new = value[n] == " ", body[n] != " "
                    now = (not blank, blank and not new, blank and new, blank and not new and n in halts)
                    stack[-1][1][:] = map(max, stack[-1][1], now)
                stack.append((value, [False] * 4))
                last = (value, *[True] * 4, part, None, None)
            yield table(out)
        # what is still open, and the ends of the range for its neighbours
        yield table([(v, *found, None, None, None) for v, found in stack if any(found)] + [r for r in (first, last) if r])

    schema = "value string, in_word boolean, in_cue boolean, new_cue boolean, halted boolean, part int, body string, halts array<int>"
    ranges = own.repartitionByRange(F.substring("value", 1, RANGE))
    walked = materialize(ranges.sortWithinPartitions("value").mapInArrow(walk, schema))
    inner = walked.filter("part IS NULL").select("value", *flags)
    firsts = walked.filter("part IS NOT NULL AND halted IS NULL").select("part", F.struct("value", "body", "halts").alias("next"))
    # one row a range: each with the first value of the range behind it
    after = firsts.select(F.lag("part").over(Window.partitionBy(F.lit(0)).orderBy("part")).alias("part"), "next")
    lasts = walked.filter("part IS NOT NULL AND halted").select("value", "part")
    met = lasts.join(after, "part").filter(F.startswith(F.col("next.value"), F.col("value")))
    n = F.length("value")
    at = lambda c: F.substring(F.col(c), n + 1, F.lit(1)) == " "
    blank, new = at("next.value"), ~at("next.body")
    outer = met.select("value", (~blank).alias("in_word"), (blank & ~new).alias("in_cue"), (blank & new).alias("new_cue"), (blank & ~new & F.array_contains("next.halts", n)).alias("halted"))
    return inner.unionByName(outer).groupBy("value").agg(*(F.bool_or(c).alias(c) for c in flags))


def _copies(bodies: DataFrame) -> DataFrame:
    """_d, in_word, in_cue, new_cue, halted: the files whose dialogue is a strict prefix of another's, and how such go on.

    Files of more than OPENING words are compared where they share their opening, all others with the openings of all.
    """
    value = _plain(F.col("body")).alias("value")
    openings = bodies.filter("opening IS NOT NULL").select("opening", F.xxhash64(value).alias("h")).groupBy("opening").agg(F.min("h").alias("a"), F.max("h").alias("b"))
    # written first: their size is then known, and few of them reach the dialogues without a shuffle of these
    openings = materialize(openings.filter("a != b").select("opening"))
    shared = bodies.join(openings, "opening", "left_semi").select("doc", value, "body", "halts")
    # a short body ends within the first OPENING words of a copy
    first = F.substring_index("value", " ", 1)
    few = bodies.filter("opening IS NULL").select("doc", value, "body", "halts")
    heads = bodies.filter("opening IS NOT NULL").select(F.substring_index(value, " ", OPENING + 1).alias("value"), "body", "halts")
    heads = heads.select("value", F.substring(F.col("body"), F.lit(1), F.length("value")).alias("body"), F.filter("halts", lambda p: p <= F.length("value")).alias("halts"))
    heads = heads.join(materialize(few.select(first.alias("_f")).distinct()), first == F.col("_f"), "left_semi").select("body", "halts")
    out = None
    for files, values in ((shared, shared.select("body", "halts")), (few, few.select("body", "halts").unionByName(heads))):
        part = files.select(F.col("doc").alias("_d"), "value").join(strict_prefixes(values), "value").drop("value")
        out = part if out is None else out.unionByName(part)
    return out


def occurrences(ends: DataFrame, values: DataFrame) -> DataFrame:
    """value, total, longer: for each distinct ``value`` of ends, how often it and strictly longer ones with it as prefix occur.

    ``values`` has value and n, its number of occurrences, and may repeat values. Values are hashed only at the lengths
    that ends with the same first KEY characters have; shorter ends meet the first KEY characters of all values, which
    are counted before. No two texts are compared one by one. Null and empty values take no part.
    """
    ends = ends.filter(F.length("value") > 0).select("value").distinct()
    size, start = F.length("value"), F.substring("value", 1, KEY)
    far = ends.filter(size >= KEY).select(start.alias("key"), "value")
    near = ends.filter(size < KEY).select(F.substring("value", 1, 1).alias("key"), "value")
    long = values.filter(size >= KEY).select(start.alias("key"), "value", size.alias("size"), "n")
    heads = values.filter(size > 0).groupBy(start.alias("value"), F.least(size, F.lit(KEY)).alias("size")).agg(F.sum("n").alias("n"))
    heads = heads.select(F.substring("value", 1, 1).alias("key"), "value", "size", "n")
    out = None
    for short, own in ((far, long), (near, heads)):
        short = short.withColumns({"at": F.length("value"), "h": F.xxhash64("value")})
        lengths = short.groupBy("key").agg(F.collect_set("at").alias("lengths"))
        if own is long:  # written first: while they are few, no value is shuffled
            lengths = materialize(lengths)
        hits = own.join(lengths, "key").select("key", "value", "size", "n", F.explode(F.filter("lengths", lambda k: k <= F.col("size"))).alias("at"))
        hits = hits.select("key", "at", F.xxhash64(F.substring(F.col("value"), F.lit(1), F.col("at"))).alias("h"), (F.col("at") == F.col("size")).alias("same"), "n")
        sums = hits.groupBy("key", "at", "h").agg(F.sum(F.when(F.col("same"), F.col("n")).otherwise(0)).alias("total"), F.sum(F.when(~F.col("same"), F.col("n")).otherwise(0)).alias("longer"))
        part = short.join(sums, ["key", "at", "h"]).select("value", "total", "longer")
        out = part if out is None else out.unionByName(part)
    return out


def _complete_cues(bodies: DataFrame) -> DataFrame:
    """value, n: the complete cues that no mark closes, asides too; a file's last cue is none."""
    # what stands before a line feed, behind the closed cues before it; and no last cue
    said = F.split("body", "\n")
    said = F.slice(said, F.lit(1), F.size(said) - 1)
    values = bodies.select(F.explode(F.concat(said, F.split("asides", "\n"))).alias("value"))
    return values.select(F.substring_index("value", "\r", -1).alias("value"), F.lit(1).alias("n")).filter("value != ''")


def judge(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", phrases: Sequence[str] = (), debug: bool = False) -> DataFrame:
    """doc_id, source, cut, why: every file that isn't blank, whether it was cut off and by which sign.

    A ``why`` that begins with 'prefix' comes from a prefix join, any other from a sign that needs no copy. Null and blank
    texts are left out. ``phrases`` begin cues that are known credits or adverts. A null source is a source of its own without limits. Equal texts in one source are judged alike.
    ``doc_id`` must not be null. Other columns are ignored; an empty table gives no rows.
    """
    kind = dict(docs.dtypes)[doc_id]
    rows = docs.filter(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc"), F.col(source).alias("source"), F.col(text).alias("text"))
    read = materialize(spread(rows).mapInArrow(_read(subtitles.forms(phrases)), _ENDS.format(kind=kind)))
    whole = read.filter(F.col("key").isNull())
    files = whole.drop("key", "total", "ends", "body", "halts", "asides")
    # each side of the last join is written first: adaptive execution plans and describes all joins anew at every stage of a
    # query, so that one over all of them takes the driver's memory
    copies = materialize(_copies(whole.filter("body != ''").select("doc", "opening", "body", "halts")))
    counted = materialize(read.filter(F.col("key").isNotNull()).groupBy("key").agg(F.sum("total").alias("total"), F.sum("ends").alias("ends")))
    # ends that no mark closes are joined as words, cue heads and cues
    open_end = ~F.col("stop") & ~F.col("trail")
    open_files = files.filter(open_end & (F.col("cue") != ""))
    word, head = F.concat(F.lit("w "), F.col("word")), F.concat(F.lit("h "), F.col("head"))
    wanted = files.select(F.explode(F.array_compact(F.array(F.when(F.col("word") != "", word), head))).alias("value"))
    keys = counted.select(F.col("key").alias("value"), F.col("total").alias("n"))
    known = occurrences(wanted, keys).join(counted.select(F.col("key").alias("value"), "ends"), "value", "left").na.fill(0, ["ends"])
    known = materialize(known)
    w = known.select(F.col("value").alias("_w"), F.col("total").alias("w_total"), F.col("ends").alias("w_ends"), F.col("longer").alias("w_longer"))
    h = known.select(F.col("value").alias("_h"), F.col("longer").alias("h_longer"))
    c = occurrences(open_files.select(F.col("cue").alias("value")), _complete_cues(whole)).withColumnsRenamed({"value": "_c", "total": "c_total", "longer": "c_longer"})
    tails = files.filter("cue != ''").select(F.col("cue").alias("_c"), "n_chars").distinct().groupBy("_c").agg(F.count(F.lit(1)).alias("tails")).filter(F.col("tails") >= TAILS)
    c = c.unionByName(tails, allowMissingColumns=True).groupBy("_c").agg(*(F.max(k).alias(k) for k in ("c_total", "c_longer", "tails")))
    c = materialize(c)
    counts = materialize(_lengths(files))
    limits, blocks = materialize(_limits(counts)), materialize(_blocks(counts).withColumnRenamed("source", "_s3"))
    chars = limits.filter("unit = 'c'").select(F.col("source").alias("_s1"), F.col("n").alias("_n1"))
    octets = limits.filter("unit = 'b'").select(F.col("source").alias("_s2"), F.col("n").alias("_n2"))
    full = files.join(w, word == F.col("_w"), "left").join(h, head == F.col("_h"), "left").join(c, F.col("cue") == F.col("_c"), "left")
    full = full.join(chars, (F.col("source") == F.col("_s1")) & (F.col("n_chars") == F.col("_n1")), "left")
    full = full.join(octets, (F.col("source") == F.col("_s2")) & (F.col("n_bytes") == F.col("_n2")), "left")
    full = full.join(blocks, F.col("source") == F.col("_s3"), "left")
    full = full.join(copies, F.col("doc") == F.col("_d"), "left")
    zero = lambda name: F.coalesce(F.col(name), F.lit(0))
    yes = lambda name: F.coalesce(F.col(name), F.lit(False))
    multiple = lambda n, sizes: F.coalesce(F.exists(sizes, lambda b: (F.col(n) > 0) & (F.col(n) % b == 0)), F.lit(False))
    at_limit = F.col("_n1").isNotNull() | F.col("_n2").isNotNull() | multiple("n_chars", "c_blocks") | multiple("n_bytes", "b_blocks")
    complete_cue = (zero("c_total") >= 2) & (zero("c_total") >= 0.05 * zero("c_longer"))
    complete_cue = complete_cue | ((zero("tails") > 0) & (zero("tails") >= TAIL_SHARE * zero("c_longer")))
    part_head = zero("h_longer") >= 1
    spoken = ~F.col("aside") & ~F.col("credit") & (F.col("word") != "")
    part_word = spoken & open_end & ~complete_cue & (zero("w_longer") >= 1) & (zero("w_total") < PART * (zero("w_total") + zero("w_longer")))
    # a word that ends cues elsewhere may well end this one, though another goes on
    seldom = zero("w_ends") < ENDS_CUE * zero("w_total")
    part_cue = open_end & ~F.col("aside") & (zero("c_total") == 0) & (zero("c_longer") >= 2) & ~complete_cue & seldom
    never_last = (zero("w_total") >= FREQUENT) & (zero("w_ends") < ENDS * zero("w_total"))
    shut = F.col("stop") | F.col("aside") | complete_cue
    # an end that is closed here, but not there, is its author's
    in_cue = yes("in_cue") & (open_end | yes("halted"))
    goes_on = spoken & ~F.col("turn") & (in_cue | (yes("in_word") & open_end))
    ended = spoken & yes("new_cue") & ~goes_on
    why = (
        F.when(goes_on, "prefix of a longer copy")
        .when(part_head, "prefix of a cue head")
        .when(part_word, "prefix of a longer word")
        .when(part_cue, "prefix of a longer cue")
        .when(F.col("broken"), "broken character")
        .when(F.col("turn"), "broken cue head")
        .when(at_limit & F.col("trail"), "limit")
        .when(F.col("trail") | shut | ended, None)
        .when(at_limit, "limit")
        .when(F.col("credit"), None)
        .when(F.col("closes") >= CLOSES, "open sentence")
        .when(never_last, "word that ends no cue")
    )
    if debug:
        return full.withColumn("why", why).withColumns({"part_head": part_head, "part_word": part_word, "part_cue": part_cue, "goes_on": goes_on, "at_limit": at_limit, "ended": ended, "complete_cue": complete_cue, "seldom": seldom})
    return full.select(F.col("doc").alias(doc_id), F.col("source").alias(source), why.isNotNull().alias("cut"), why.alias("why"))


def by_source(judged: DataFrame, *, source: str = "source") -> DataFrame:
    """Per source: files that aren't blank, how many were cut, and their share."""
    out = judged.groupBy(source).agg(F.count(F.lit(1)).alias("n_files"), F.count_if("cut").alias("n_cut"))
    return out.withColumn("share", F.col("n_cut") / F.col("n_files"))
