"""Fuzzy line dedup (operator 1): SimHash, pigeonhole join, verified edit similarity, one line kept of each group.

A line is normalised: A-Z lower-cased, digits made 0, other ASCII marks made spaces, words joined by one space. Lines of
equal normalised text are copies. A feature is a word with how many of it came before in the line; features are dealt by
their hash into classes, and a line's fingerprint is a row of blocks, one SimHash for each class (``block_keys``). An edited
word touches two classes at most, its old and its new one, so of two lines that differ in fewer than half as many words as
there are classes some block agrees. The number of classes grows with the line (``classes_of``), so a block always stands
for CLASS_CHARS to twice as many characters:

* long lines are candidates if one block of at least LONG_WORDS words agrees;
* lines of under SHORT_CHARS characters have four classes, of which two with at least SHORT_WORDS words together must agree;
* lines whose length is within STRADDLE of the next number of classes have the keys of both.

Each agreement is a key of an equi-join. Candidates whose SimHashes over all features differ in over DISTANCE of 64 bits are
left out. A pair links if its edit similarity, 1 - distance / longer length, is at least SIMILARITY. Pairs that could only
connect what verified pairs connect already are not compared (``near_links``), so a large group of near copies costs its size,
not its square, and groups are those of all candidate pairs. Of each group the occurrence that comes first by (id, hashes of the text, line number) stays, and all
others go, wherever they stand.

Nothing grows with a group of copies but counts: copies are one row in all joins of candidates, hot partitions of stored
tables can be split by Spark, and only lines that take part in a pair have their text fetched, marked by a bitmap whose size
follows their number. Keys are shuffled packed, many to a row, and a task sorts one part of them at a time (``bucket_members``),
so a bucket's lines, 24 bytes each, must have room in a task.

Defined cases: a null text stays null and has no lines; lines without a word always stay, and count as kept; null ids
come first; rows are told apart by id and 128 bits of the text, and rows equal in both are decided alike; an empty table
gives an empty one; a line of any length is seen whole; a line of one word has no near lines, only copies; other columns are
passed on as they are, those named like a result as ``input_`` and the name.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repograph.llm.components import connected_components
from repograph.llm.hashing import U64, WORDS_ONLY, bit_counts, majority, mix, word_bounds, word_hashes
from repograph.llm.marks import bitmap, marked
from repograph.llm.storage import Workspace
from repograph.llm.textmap import as_bytes, free_names, pieces, tidy

SIMILARITY = 0.8
#: Bits of the SimHash over all features; at an edit similarity of 0.8 few pairs differ in more.
DISTANCE = 16
CLASS_CHARS, LONG_WORDS = 32, 3
#: Of lines over so many characters the trigrams are compared first: the time of what follows grows with the square.
LONG_CHARS = 2048
SHORT_CHARS, SHORT_CLASSES, SHORT_WORDS = 64, 4, 2
STRADDLE = 1.1
#: A task remembers so many lines whose keys it has given; those it forgets it gives again.
REMEMBERED = 1 << 16
#: Parts of the keys to a shuffle partition, and how many keys (24 bytes each) a task packs at once.
PARTS, DEALT = 16, 1 << 19

_LINES = bytes(0x30 if 0x30 <= b <= 0x39 else 0x0A if b == 0x0A else c for b, c in enumerate(WORDS_ONLY))


def normalised_texts(texts: list[bytes | None]) -> list[list[bytes]]:
    """The normalised lines of each text, empty where a line has no word."""
    # zero bytes are spaces by now, so they can part the texts
    a = np.frombuffer(b"\0".join(t.translate(_LINES) for t in texts if t is not None), np.uint8)
    keep = a != 0x20
    keep[1:] |= a[:-1] > 0x20  # of several spaces the first, and none before the first word
    a = a[keep]
    keep = a != 0x20
    keep[:-1] |= a[1:] > 0x20  # none after the last word
    every = iter(a[keep].tobytes().split(b"\0"))
    return [next(every).split(b"\n") if t is not None else [] for t in texts]


def normalised(text: bytes | None) -> list[bytes]:
    return normalised_texts([text])[0]


#: Bits of a sort key: the line, then its class, then the feature.
_LINE_BITS, _CLASS_BITS = 20, 16
_REST_BITS = 64 - _LINE_BITS - _CLASS_BITS


def features(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(line, feature), by line, of at most 2^20 lines: a feature is a hash of (word, how many of it came before)."""
    a, starts, ends = word_bounds(b"\n".join(lines))
    sizes = np.fromiter(map(len, lines), np.int64, len(lines)) + 1
    counts = np.diff(np.append(np.searchsorted(starts, np.cumsum(sizes) - sizes), len(starts)))
    word_bits = U64(64 - _LINE_BITS)
    ordered = (np.repeat(np.arange(len(lines), dtype=U64), counts) << word_bits) | (word_hashes(a, starts, ends) >> U64(_LINE_BITS))
    ordered.sort()
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    nth = np.arange(len(ordered)) - np.maximum.accumulate(np.where(new, np.arange(len(ordered)), 0))
    line = (ordered >> word_bits).astype(np.int64)
    word = ordered & ((U64(1) << word_bits) - U64(1))
    return line, mix(word * U64(0x9E3779B97F4A7C15) + nth.astype(U64))


def classes_of(chars: np.ndarray) -> np.ndarray:
    """How many classes a line of so many characters has; 0 for a short line."""
    power = np.floor(np.log2(np.maximum(chars / CLASS_CHARS, 1.0)) + 1e-9)
    classes = np.clip(1 << power.astype(np.int64), SHORT_CLASSES, 1 << _CLASS_BITS)
    return np.where(chars < SHORT_CHARS, 0, classes)


def block_keys(line: np.ndarray, feature: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, key) of every key of every line, by line, from the features, and each line's SimHash over all features;
    ``chars`` has a length for each line."""
    out, prints = [], np.zeros(len(chars), U64)
    own, next_ = classes_of(chars), classes_of(chars * STRADDLE)
    for classes, some in ((own, np.ones(len(chars), bool)), (next_, next_ != own)):
        here = some[line]
        at, value = line[here], feature[here]
        dealt = np.where(classes, classes, SHORT_CLASSES).astype(U64) - U64(1)
        packed = (at.astype(U64) << U64(64 - _LINE_BITS)) | ((value & dealt[at]) << U64(_REST_BITS)) | (value >> U64(64 - _REST_BITS))
        packed.sort()
        block = packed >> U64(_REST_BITS)
        first = np.flatnonzero(np.append(True, block[1:] != block[:-1])[: len(block)])
        words = np.diff(np.append(first, len(block)))
        of = (block[first] >> U64(_CLASS_BITS)).astype(np.int64)
        number = block[first] & U64((1 << _CLASS_BITS) - 1)
        bits = bit_counts(mix((packed & U64((1 << _REST_BITS) - 1)) + U64(1)), words)
        if classes is own and len(of):  # what the classes count is what the line counts
            begins = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            every = np.add.reduceat(words, begins)
            if bits.dtype == np.uint8:  # eight counters at once, where they hold what a line counts
                whole = majority(np.add.reduceat(bits.view(U64), begins, axis=0).view(np.uint8), every)
                for k in np.flatnonzero(every > 255).tolist():
                    until = begins[k + 1] if k + 1 < len(begins) else len(bits)
                    whole[k : k + 1] = majority(bits[begins[k] : until].sum(axis=0, dtype=np.int64)[None], every[k : k + 1])
            else:
                whole = majority(np.add.reduceat(bits, begins, axis=0, dtype=np.uint32), every)
            prints[of[begins]] = whole
        name = mix(majority(bits, words) + ((classes[of].astype(U64) << U64(_CLASS_BITS)) + number) * U64(0x9E3779B97F4A7C15))
        long_ = (classes[of] > 0) & (words >= LONG_WORDS)
        out.append((of[long_], name[long_]))
        short = np.flatnonzero(some & (classes == 0))
        if len(short):
            row = np.full(len(chars), -1)
            row[short] = np.arange(len(short))
            names, held = np.zeros((len(short), SHORT_CLASSES), U64), np.zeros((len(short), SHORT_CLASSES), np.int64)
            cells = classes[of] == 0
            names[row[of[cells]], number[cells].astype(np.int64)] = name[cells]
            held[row[of[cells]], number[cells].astype(np.int64)] = words[cells]
            for x, y in combinations(range(SHORT_CLASSES), 2):
                enough = held[:, x] + held[:, y] >= SHORT_WORDS
                out.append((short[enough], mix(mix(names[enough, x] + U64(x + 1)) + names[enough, y] + U64(y + 1))))
    lines, keys = (np.concatenate(x) for x in zip(*out))
    order = np.argsort(lines, kind="stable")
    return lines[order], keys[order], prints


def digest(line: bytes) -> bytes:
    return xxhash.xxh3_128_digest(line)


def fingerprints(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each line its SimHash over all features, and where its keys end in the keys of all."""
    prints, ends, keys, before = [], [], [], 0
    for start in range(0, len(lines), 1 << _LINE_BITS):
        some = lines[start : start + (1 << _LINE_BITS)]
        line, feature = features(some)
        chars = np.fromiter((len(x.decode()) if not x.isascii() else len(x) for x in some), np.int64, len(some))
        of, own, whole = block_keys(line, feature, chars)
        prints.append(whole)
        ends.append(before + np.cumsum(np.bincount(of, minlength=len(some))))
        keys.append(own)
        before += len(own)
    return tuple(np.concatenate(x) if x else np.zeros(0, U64) for x in (prints, ends, keys))


ROW = ["id", "s1", "s2"]
OCCURRENCE = "id {0}, s1 long, s2 long, line int, name binary, node long, fp long, keys binary"


def occurrences(documents: DataFrame) -> DataFrame:
    """Of (id, s1, s2, text): a row for each line with a word; ``node`` (of the name), SimHash and keys (8 bytes each, side
    by side) are null where the task has given them just before."""
    schema = OCCURRENCE.format(documents.schema["id"].dataType.simpleString())

    def run(batches):
        remembered = np.zeros(REMEMBERED, U64)
        for batch in batches:
            for piece in pieces(batch, "text"):
                row, number, lines = [], [], []
                for i, found in enumerate(normalised_texts(as_bytes(piece.column("text")))):
                    for k, line in enumerate(found):
                        if line:
                            row.append(i)
                            number.append(k)
                            lines.append(line)
                if not lines:
                    continue
                at = pa.array(row, pa.int64())
                names = list(map(digest, lines))
                nodes = np.frombuffer(b"".join(names), "<u8")[::2]
                given, first = np.unique(nodes, return_index=True)
                slot = (given & U64(REMEMBERED - 1)).astype(np.int64)
                first = np.sort(first[remembered[slot] != given])
                remembered[slot] = given
                prints, ends, keys = fingerprints([lines[i] for i in first.tolist()])
                held = np.zeros(len(lines), bool)
                held[first] = True
                place = np.where(held, np.cumsum(held) - 1, 0)
                sizes = np.zeros(len(lines), np.int64)
                sizes[first] = np.diff(ends, prepend=0)
                offsets = np.append(0, 8 * np.cumsum(sizes)).astype(np.int32)
                buffers = [np.packbits(held, bitorder="little"), offsets, np.ascontiguousarray(keys)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(piece.column(c).take(at) for c in ROW),
                        pa.array(number, pa.int32()),
                        pa.array(names, pa.binary()),
                        pa.array(nodes.view(np.int64), mask=~held),
                        pa.array(prints.view(np.int64)[place] if len(prints) else np.zeros(len(lines), np.int64), mask=~held),
                        pa.Array.from_buffers(pa.binary(), len(lines), list(map(pa.py_buffer, buffers))),
                    ],
                    names=[*ROW, "line", "name", "node", "fp", "keys"],
                )

    return documents.mapInArrow(tidy(run), schema)


def _near(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= DISTANCE


def _pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b), a < b, once each."""
    ordered = df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    return ordered.where("a < b").distinct()


def dealt_keys(found: DataFrame, parts: int) -> DataFrame:
    """(part, packed): the (key, node, fp) of all lines that a task gives, packed side by side by the part of their key, so
    the shuffle moves a row for each part of DEALT keys instead of one for each key."""

    def dealt(rows):
        rows = np.concatenate(rows)
        part = ((rows[:, 0] >> U64(32)) % U64(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        part = part[order]
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        offsets = (np.append(first, len(part)) * 24).astype(np.int32)
        packed = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(rows[order])])
        return pa.RecordBatch.from_arrays([pa.array(part[first]), packed], names=["part", "packed"])

    def run(batches):
        rows, held = [], 0
        for batch in batches:
            keys = as_bytes(batch.column("keys"))
            counts = np.fromiter(map(len, keys), np.int64, len(keys)) // 8
            some = np.empty((int(counts.sum()), 3), U64)
            some[:, 0] = np.frombuffer(b"".join(keys), U64)
            for at, column in enumerate(("node", "fp"), 1):
                some[:, at] = np.repeat(batch.column(column).to_numpy().view(U64), counts)
            rows.append(some)
            held += len(some)
            if held >= DEALT:
                yield dealt(rows)
                rows, held = [], 0
        if held:
            yield dealt(rows)

    return found.where("keys IS NOT NULL").select("node", "fp", "keys").mapInArrow(tidy(run), "part int, packed binary")


MEMBER = ["key", "node", "fp", "copies", "pivot", "pivot_fp", "size"]


def members_of(packed: bytes) -> list[np.ndarray]:
    """The columns of MEMBER, of the buckets with several lines among packed (key, node, fp): each line once, with how often
    it was given (often copied lines are given by many tasks), the bucket's pivot and size.

    The pivot is the line that was given most often (what near copies were made from is often copied, and near to all of
    them), of ties one by a hash.
    """
    rows = np.frombuffer(packed, U64).reshape(-1, 3)
    order = np.argsort(rows[:, 0])
    key, node = rows[order, 0], rows[order, 1]
    new = np.append(True, key[1:] != key[:-1])
    first = np.flatnonzero(new)
    unlike = ~new & np.append(False, node[1:] != node[:-1])
    several = np.repeat(np.logical_or.reduceat(unlike, first), np.diff(np.append(first, len(key))))
    rows = rows[order[several]]
    if not len(rows):
        return []
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]).any(axis=1)))
    copies = np.diff(np.append(first, len(rows)))
    key, node, fp = rows[first].T
    order = np.lexsort((node, mix(node), copies, key))  # the last of each key
    ends = np.flatnonzero(np.append(key[1:] != key[:-1], True))
    size = np.diff(np.append(-1, ends))
    pivot = np.repeat(order[ends], size)
    return [key, node, fp, copies, node[pivot], fp[pivot], np.repeat(size, size)]


def bucket_members(found: DataFrame) -> DataFrame:
    """MEMBER of the buckets with several lines; a task has one part of the keys in memory at a time."""
    parts = PARTS * int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        here, held = None, []
        for batch in batches:
            part, packed = batch.column("part").to_numpy(), as_bytes(batch.column("packed"))
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            for start, end in zip(cuts, cuts[1:]):
                if part[start] != here:
                    if held and (columns := members_of(b"".join(held))):
                        yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], names=MEMBER)
                    here, held = part[start], []
                held += packed[start:end]
        if held and (columns := members_of(b"".join(held))):
            yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], names=MEMBER)

    sorted_ = dealt_keys(found, parts).repartition("part").sortWithinPartitions("part")
    return sorted_.mapInArrow(tidy(run), ", ".join(f"{c} long" for c in MEMBER))


def with_pivots(members: DataFrame) -> DataFrame:
    """With the line of most copies among those of the bucket, of ties the first by a hash, and their number. ``members`` has
    key, node, fp and copies."""
    order = F.struct("copies", F.xxhash64("node").alias("h"), "node", "fp")
    pivots = members.groupBy("key").agg(F.max(order).alias("p"), F.count("*").alias("size"))
    return members.join(pivots.select("key", F.col("p.node").alias("pivot"), F.col("p.fp").alias("pivot_fp"), "size"), "key")


def labelled(df: DataFrame, labels: DataFrame, *ends: str) -> DataFrame:
    """With ``label_`` of each end: its component's, or its own where it has none."""
    for end in ends:
        own = labels.select(F.col("node").alias(end), F.col("label").alias(f"label_{end}"))
        df = df.join(own, end, "left").withColumn(f"label_{end}", F.coalesce(f"label_{end}", end))
    return df


#: How many words of either text an alignment passes over to go on, the fewest first.
REACH = 6
_SKIPS = [(d, t - d) for t in range(1, REACH + 1) for d in range(t + 1)]


def alignment_cost(a: str, b: str, most: int) -> int:
    """An upper bound of the edit distance: the cost of one alignment of the words, over ``most`` if that is exceeded.

    Where words differ, the nearest place at which both texts go on alike, at most REACH words away in all, is taken,
    and what lies between is replaced.
    """
    x, y = a.split(" "), b.split(" ")
    n, m = len(x), len(y)
    x += [None] * (REACH + 1)  # ends that equal no word, and not each other
    y += [False] * (REACH + 1)
    i = j = cost = 0
    while i < n and j < m and cost <= most:
        if x[i] == y[j]:
            i += 1
            j += 1
            continue
        for d, e in _SKIPS:
            if x[i + d] == y[j + e]:
                break
        else:
            d = e = 1
        cost += max(sum(map(len, x[i : i + d])) + d, sum(map(len, y[j : j + e])) + e)
        i += d
        j += e
    return cost + max(sum(map(len, x[i:n])) + n - i, sum(map(len, y[j:m])) + m - j)


#: Columns after which a lower bound is looked at.
STRETCH = 48


def may_be_within(a: str, b: str, most: int) -> bool:
    """Whether the longest common subsequence allows an edit distance of ``most``: what it leaves of the longer text must be
    edited. Its bits cost less than the edit matrix, only places up to ``most`` apart can match, and it ends as soon as all
    that is to come could match without changing the answer."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    whole = unmatched = (1 << len(a)) - 1
    width = (1 << (2 * most + STRETCH)) - 1
    longer = max(len(a), len(b))
    for start in range(0, len(b), STRETCH):
        band = width << start - most if start > most else width >> most - start
        near = {c: places & band for c, places in at.items()}
        for c in b[start : start + STRETCH]:
            match = unmatched & near.get(c, 0)
            unmatched = (unmatched + match) | (unmatched - match)
        unmatched &= whole
        if longer - (len(a) - unmatched.bit_count()) - max(0, len(b) - start - STRETCH) > most:
            return False
    return bool(b) or len(a) <= most


def unlike_parts(a: str, b: str) -> tuple[str, str]:
    """Both without their common beginning and end."""
    start, least = 0, min(len(a), len(b))
    while start < least and a[start] == b[start]:
        start += 1
    end = 0
    while end < least - start and a[-1 - end] == b[-1 - end]:
        end += 1
    return a[start : len(a) - end], b[start : len(b) - end]


def edit_distance(a: str, b: str) -> int:
    """Of what is left without a common beginning and end, by bit-parallel columns of the edit matrix."""
    a, b = sorted(unlike_parts(a, b), key=len)
    if not a:
        return len(b)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    mask, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    higher, lower, distance = mask, 0, len(a)
    for c in b:
        match = at.get(c, 0)
        stay = match | lower
        carry = (((match & higher) + higher) ^ higher) | match
        rise, fall = lower | (mask & ~(carry | higher)), higher & carry
        if rise & top:
            distance += 1
        elif fall & top:
            distance -= 1
        rise, fall = (rise << 1 | 1) & mask, fall << 1 & mask
        higher, lower = fall | (mask & ~(stay | rise)), rise & stay
    return distance


def trigrams(text: str) -> set:
    return set(zip(text, text[1:], text[2:]))


def similar(a: str, b: str, similarity: float) -> bool:
    """Whether the edit similarity is at least that. Lengths exclude it, a cheap alignment settles most pairs; an edit takes
    at most three trigrams away, which excludes long lines, and the longest common subsequence most of the others; the
    matrix decides the rest."""
    most = int(max(len(a), len(b)) * (1 - similarity) + 1e-6)
    if abs(len(a) - len(b)) > most:
        return False
    if alignment_cost(a, b, most) <= most:
        return True
    if max(len(a), len(b)) > LONG_CHARS and len(trigrams(a) - trigrams(b)) > 3 * most:
        return False
    a, b = unlike_parts(a, b)
    return may_be_within(a, b, most) and edit_distance(a, b) <= most


def similar_pairs(pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose texts (text_a, text_b) have at least that edit similarity, without the texts."""
    kept = [c for c in pairs.columns if c not in ("text_a", "text_b")]

    def run(batches):
        for batch in batches:
            like = [similar(a, b, similarity) for a, b in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist())]
            yield batch.select(kept).filter(pa.array(like, pa.bool_()))

    return pairs.mapInArrow(tidy(run), T.StructType([pairs.schema[c] for c in kept]))


def wanted_lines(documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, name, line) with the normalised text of every line of these nodes, once each."""
    held = bitmap(nodes)

    def run(batches):
        given: set[bytes] = set()
        for batch in batches:
            for piece in pieces(batch, "text"):
                lines = [line for found in normalised_texts(as_bytes(piece.column("text"))) for line in found if line]
                own = list(map(digest, lines))
                nodes = np.frombuffer(b"".join(own), "<u8")[::2].copy()
                here = np.flatnonzero(marked(held.value, nodes)).tolist()
                found = {own[i]: i for i in here if own[i] not in given}
                places = list(found.values())
                if len(given) > REMEMBERED:
                    given.clear()
                given.update(found)
                texts = pa.array([lines[i] for i in places], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(nodes[places].view(np.int64)), pa.array(list(found), pa.binary()), texts], names=["node", "name", "line"])

    texts = documents.select("text").mapInArrow(tidy(run), "node long, name binary, line string")
    return texts.join(nodes, "node", "left_semi").groupBy("node", "name").agg(F.first("line").alias("line"))


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(a, b, name_a, name_b) of the pairs that are similar: should two lines share a node, the pairs of both."""
    for end in ("a", "b"):
        pairs = pairs.join(texts.select(F.col("node").alias(end), F.col("name").alias(f"name_{end}"), F.col("line").alias(f"text_{end}")), end)
    return similar_pairs(pairs, similarity)


def near_links(documents: DataFrame, found: DataFrame, work: Workspace, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b), names of similar lines; their components are those of all candidate pairs that are similar.

    Members of a bucket go with its pivot; those not connected to it then go with one of themselves; at last all pairs of a
    bucket are compared that lie in different components.
    """
    members = work.keep(bucket_members(found), "members")
    near = members.where((F.col("node") != F.col("pivot")) & _near("fp", "pivot_fp"))
    far = members.where("size > 2").where(~_near("fp", "pivot_fp"))
    ends = near.select(F.explode(F.array("node", "pivot")).alias("node")).union(far.select("node")).distinct()
    texts = work.keep(wanted_lines(documents, work.keep(ends, "ends")), "texts")
    first = work.keep(_pairs(near, "node", "pivot"), "first")
    sure = work.keep(_verified(first, texts, similarity), "sure")
    # those that aren't connected to the pivot, with one of themselves
    firm = work.keep(connected_components(sure, work), "firm")
    alone = labelled(members.where("size > 2"), firm, "node", "pivot").where("label_node <> label_pivot")
    alone = work.keep(alone.select("key", "node", "fp", "copies", "label_node"), "alone")
    again = with_pivots(alone.drop("label_node")).where((F.col("node") != F.col("pivot")) & _near("fp", "pivot_fp"))
    again = _pairs(labelled(again, firm, "node", "pivot").where("label_node <> label_pivot"), "node", "pivot")
    second = work.keep(again.join(first, ["a", "b"], "left_anti"), "second")
    more = work.keep(_verified(second, texts, similarity), "more")
    # what is still apart: the components are part of the join, so what is connected makes no rows
    whole = work.keep(connected_components(sure.union(more), work), "whole")
    left = labelled(alone.select("key", "node", "fp"), whole, "node").toDF("own", "key", "own_fp", "own_label")
    others = labelled(members.where("size > 2").select("key", "node", "fp"), whole, "node")
    pairs = left.join(others, "key").where((F.col("own_label") != F.col("label_node")) & _near("own_fp", "fp"))
    third = work.keep(_pairs(pairs, "own", "node").join(first.union(second), ["a", "b"], "left_anti"), "third")
    last = work.keep(_verified(third, texts, similarity), "last")
    return sure.union(more).union(last).select(F.col("name_a").alias("a"), F.col("name_b").alias("b"))


def dropped_lines(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Of (id, s1, s2, text): (id, s1, s2, lines), the numbers of the lines to drop of each document that has some."""
    work = Workspace(documents.sparkSession, "line-dedup")
    found = work.keep(occurrences(documents), "occurrences")
    repeated = work.keep(found.groupBy("name").agg(F.count("*").alias("copies")).where("copies > 1"), "repeated")
    labels = work.keep(connected_components(near_links(documents, found, work, similarity), work), "labels").withColumnRenamed("node", "name")
    # only lines that are not alone go on: copies, and those of a group
    grouped = repeated.select("name").join(labels, "name", "full").select("name", F.coalesce("label", "name").alias("label"))
    place = F.struct(*ROW, "line")
    several = work.keep(found.select(*ROW, "line", "name").join(work.keep(grouped, "grouped"), "name").select("label", place.alias("place")), "several")
    stays = work.keep(several.groupBy("label").agg(F.min("place").alias("stays")), "stays")
    gone = several.join(stays, "label").where(~F.col("place").eqNullSafe(F.col("stays")))
    return work.keep(gone.select("place.*").groupBy(*ROW).agg(F.collect_set("line").alias("lines")), "gone")


RESULT = ["n_lines", "n_kept"]


def dedup_lines(
    documents: DataFrame, *, id_col: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, prefix: str = ""
) -> DataFrame:
    """All columns, with the text rewritten, and the numbers of its lines before and after."""
    names = [prefix + n for n in RESULT]
    passed = free_names(documents.columns, names)
    own = [f"c{i}" for i in range(len(passed))]
    at, key = documents.columns.index(text), f"c{documents.columns.index(id_col)}"
    source = documents.toDF(*own).withColumn(own[at], F.col(own[at]).cast("string"))
    marks = {"s1": F.xxhash64(own[at]), "s2": F.xxhash64(F.lit(1), F.col(own[at]))}
    gone = dropped_lines(source.select(F.col(key).alias("id"), *(c.alias(n) for n, c in marks.items()), F.col(own[at]).alias("text")), similarity)
    same = F.col(key).eqNullSafe(F.col("id")) & (marks["s1"] == F.col("s1")) & (marks["s2"] == F.col("s2"))
    # the side with the numbers is small next to the texts: a table of it spares sorting them
    joined = source.join(gone.hint("shuffle_hash"), same, "left").select(*own, "lines")
    schema = T.StructType([*(T.StructField(n, f.dataType) for n, f in zip(own, source.schema.fields)), *(T.StructField(n, T.LongType(), False) for n in RESULT)])

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, own[at]):
                texts, before, after = [], [], []
                for whole, lines in zip(as_bytes(piece.column(own[at])), piece.column("lines").to_pylist()):
                    every = [] if whole is None else whole.split(b"\n")
                    drop = set(lines or ())
                    left = [x for k, x in enumerate(every) if k not in drop]
                    before.append(len(every))
                    after.append(len(left))
                    texts.append(None if whole is None else b"\n".join(left))
                columns = [piece.column(c) for c in own]
                columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(before, pa.int64()), pa.array(after, pa.int64())], names=[*own, *RESULT])

    return joined.mapInArrow(tidy(run), schema).toDF(*passed, *names)


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with the lines that stay."""
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_lines", "n_kept", "text")
