"""Best-fit packing of tokenised documents by bin completion on the length histogram.

Packing depends only on how many pieces have each length, and there are at most ``capacity``
lengths. So the cluster counts lengths, the driver solves the histogram (at most 2048 rows,
whatever the corpus), and the cluster deals pieces to slots by their rank within a length.
Ranks are counted within salted parts of a length, so a length that holds a third of all
pieces is spread like any other.

The solver builds sequences around the largest piece left. It enumerates fillings of the
rest in which no piece could be swapped for a larger one that is left (undominated), in
order of waste, and applies the same filling as often as counts allow, or half as often, or
once. Branches whose waste
shows that they cannot beat the incumbent are cut; best-fit decreasing is the first
incumbent, and meeting the lower bound ends the search.
"""

from __future__ import annotations

import struct
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm._spark import durable

CAPACITY = 2048
PART = 20_000
NODES = 3_000
#: Splits text before the merges of the vocabulary; a fixed value of the tokenizer file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters on which regular expression engines agree; other texts go to the tokenizer whole.
COMMON = r"[\x09\x0a\x0d\x20-\x7eÀ-ÖØ-öø-ſ]*"
KNOWN = 300_000
Plan = list[tuple[tuple[int, ...], int]]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Pieces over half need a sequence each; the rest needs at least the total's share."""
    total = -(-sum(n * c for n, c in counts.items()) // capacity)
    best = total
    for small in {0, *(n for n in counts if 2 * n <= capacity)}:
        big = sum(c for n, c in counts.items() if n > capacity - small)
        half = [(n, c) for n, c in counts.items() if capacity - small >= n and 2 * n > capacity]
        rest = sum(n * c for n, c in counts.items() if small <= n and 2 * n <= capacity)
        free = sum((capacity - n) * c for n, c in half)
        best = max(best, big + sum(c for _, c in half) + max(0, -(-(rest - free) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing, on groups of sequences with the same content."""
    rooms: list[int] = []
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def add(room: int, content: tuple[int, ...], times: int) -> None:
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].append((content, times))

    for n in sorted(counts, reverse=True):
        left = counts[n]
        while left:
            i = bisect_left(rooms, n)
            if i == len(rooms):
                # New sequences take one piece each, unless that is more than full ones need.
                each = capacity // n
                full, left = divmod(left, each)
                if full:
                    add(capacity - each * n, (n,) * each, full)
                if left:
                    add(capacity - left * n, (n,) * left, 1)
                    left = 0
                continue
            room = rooms[i]
            content, times = groups[room].pop()
            if not groups[room]:
                del groups[room], rooms[i]
            each = min(room // n, left)
            use = min(times, left // each)
            if use < times:
                add(room, content, times - use)
            add(room - each * n, (*content, *[n] * each), use)
            left -= use * each
    return [(content, times) for g in groups.values() for content, times in g]


def fillings(counts: dict[int, int], lengths: list[int], gap: int, most: int, tries: int) -> list[tuple[int, tuple[int, ...]]]:
    """(waste, pieces) of undominated fillings of ``gap`` with the least waste, at most ``most``."""
    found: list[tuple[int, tuple[int, ...]]] = []
    smallest, budget = lengths[0], [tries]
    used: Counter[int] = Counter()

    def undominated(pieces: tuple[int, ...], waste: int) -> bool:
        for p in set(pieces):
            i = bisect_left(lengths, p + 1)
            while i < len(lengths) and lengths[i] <= p + waste:
                if counts[lengths[i]] > used[lengths[i]]:
                    return False
                i += 1
        return True

    def walk(gap: int, top: int, pieces: tuple[int, ...]) -> bool:
        i = min(top, bisect_left(lengths, gap + 1) - 1)
        budget[0] -= 1
        if budget[0] < 0:
            return True
        if gap < smallest or i < 0:
            if undominated(pieces, gap):
                insort(found, (gap, pieces))
                del found[most:]
            return len(found) == most and found[-1][0] == 0
        placed = False
        while i >= 0:
            n = lengths[i]
            if counts[n] > used[n]:
                placed = True
                used[n] += 1
                stop = walk(gap - n, i, (*pieces, n))
                used[n] -= 1
                if stop:
                    return True
            i -= 1
        if not placed and undominated(pieces, gap):
            insort(found, (gap, pieces))
            del found[most:]
        return False

    walk(gap, len(lengths) - 1, ())
    return found or [(gap, ())]


def solve(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> Plan:
    """Contents and multiplicities that hold every piece in as few sequences as found."""
    counts = {n: c for n, c in counts.items() if c}
    if not counts:
        return []
    best = best_fit(counts, capacity)
    size = sum(t for _, t in best)
    bound = lower_bound(counts, capacity)
    total = sum(n * c for n, c in counts.items())
    # Depth first over choices of filling; each level keeps what is left and the choices not yet tried.
    # A first dive takes a node for each length at most, so every width needs nodes of its own.
    width = 1
    while size > bound and width <= 4:
        budget = nodes
        stack: list[tuple[dict[int, int], Plan, int, int]] = [(counts, [], 0, 0)]
        while stack and budget > 0 and size > bound:
            left, plan, used, wasted = stack.pop()
            if not left:
                if used < size:
                    best, size = plan, used
                continue
            # Waste bound: a better plan has at most (size - 1) sequences to lose room in.
            if wasted > (size - 1) * capacity - total or used + -(-(total - used * capacity + wasted) // capacity) >= size:
                continue
            budget -= 1
            top = max(left)
            rest = dict(left)
            rest[top] -= 1
            lengths = sorted(n for n, c in rest.items() if c and n <= capacity - top)
            options = fillings(rest, lengths, capacity - top, width, 400) if lengths else [(capacity - top, ())]
            for waste, pieces in reversed(options):
                content = (top, *pieces)
                need = Counter(content)
                most = min(left[n] // k for n, k in need.items())
                for times in sorted({1, most // 2, most} - {0}) if width > 1 else (most,):
                    after = {n: c - times * need.get(n, 0) for n, c in left.items()}
                    stack.append(({n: c for n, c in after.items() if c}, [*plan, (content, times)], used + times, wasted + waste * times))
        width += 1
    return best


class Known(dict):
    """Ids of pieces, merged when first asked for."""

    def __init__(self, merge):
        self.merge = merge

    def __missing__(self, piece: str) -> bytes:
        ids = self.merge(piece.encode())
        self[piece] = packed = struct.pack(f"<{len(ids)}I", *ids)
        return packed


class Encoder:
    """Token ids as little-endian uint32 bytes, with the ids of pieces between merges remembered.

    Texts of common characters are split here and each distinct piece is merged once, by the
    ranks of the same vocabulary and another library's merge of one piece
    (``_core_bpe.encode_single_piece``, not part of its public interface). Texts with other
    characters or with a control string go through the tokenizer whole. Both give the ids of
    a plain ``encode(text, add_special_tokens=False)``; the tests hold them against it.
    """

    def __init__(self, path: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.split, self.common = regex.compile(PATTERN).findall, regex.compile(COMMON).fullmatch
        # Byte-level vocabularies write byte b as a printable character: itself, or the next free one from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.control = regex.compile("|".join(map(regex.escape, sorted(special))) if special else r"(?!)").search
        ranks = {bytes(byte[c] for c in word): n for word, n in self.tokenizer.get_vocab().items() if word not in special}
        merge = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.known = Known(merge)

    def ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def __call__(self, text: str) -> bytes:
        if not self.common(text) or self.control(text):
            return self.ids([text])[0]
        if len(self.known) > KNOWN:
            self.known.clear()
        return b"".join(map(self.known.__getitem__, self.split(text)))


def _cut(batches: Iterator[pa.RecordBatch], path: str, capacity: int) -> Iterator[pa.RecordBatch]:
    encode = Encoder(path)
    for batch in batches:
        for begin in range(0, batch.num_rows, 500):
            part = batch.slice(begin, 500)
            which, piece, start, length, ids = [], [], [], [], []
            for row, text in enumerate(part.column("text").to_pylist()):
                data = encode(text or "") + b"\0\0\0\0"
                n = len(data) // 4
                at = 0
                for k in range(-(-n // capacity)):
                    to = n - (-(-n // capacity) - k - 1) * capacity
                    which.append(row), piece.append(k), start.append(at), length.append(to - at), ids.append(data[4 * at : 4 * to])
                    at = to
            yield pa.record_batch({"doc_id": part.column("doc_id").take(pa.array(which, pa.int64())), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids": pa.array(ids, pa.binary())})


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids) with ids as little-endian unsigned 32-bit integers.

    A document is its token ids and a closing id 0; null and empty texts are the closing id
    alone. Documents longer than ``capacity`` are cut into pieces of that length, of which the
    first may be shorter. A control string in a text gets the id that the tokenizer gives it.
    Repeated rows give repeated pieces; extra columns are ignored; null ids are kept.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        lambda b: _cut(b, tokenizer_path, capacity), "doc_id long, piece int, start long, length long, ids binary"
    )


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``rows`` with sequence_id and offset, each row placed whole in one sequence.

    ``rows`` needs a long column ``length`` from 1 to ``capacity``; other columns are carried
    along, those named like a result column are replaced. Offsets in a sequence run from 0
    without gaps. An empty table gives no rows.
    """
    spark = rows.sparkSession
    rows = rows.drop("sequence_id", "offset", "_salt", "_part", "_rank")
    rows = durable(rows.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id())))
    histogram = {r["length"]: r["c"] for r in rows.groupBy("length").agg(F.count("*").alias("c")).collect()}
    plan = solve(histogram, capacity)

    slots, base, taken = [], 0, Counter()
    for content, times in plan:
        offset = 0
        for n, k in sorted(Counter(content).items(), reverse=True):
            slots.append((n, taken[n], taken[n] + times * k, k, base, offset))
            taken[n] += times * k
            offset += n * k
        base += times
    # At most a few thousand rows: a plan step uses up some length, and lengths are at most ``capacity``.
    table = spark.createDataFrame(slots, "length long, _from long, _to long, _each long, _base long, _at long")

    parts = -(-max(histogram.values(), default=1) // PART)
    rows = rows.withColumn("_part", F.pmod(F.col("_salt"), F.lit(parts)))
    sizes = rows.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).select("length", "_part", F.coalesce("_before", F.lit(0)).alias("_before"))
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_part").orderBy("_salt"))).join(before, ["length", "_part"]).withColumn("_rank", F.col("_before") + F.col("_rank") - 1)
    placed = ranked.join(F.broadcast(table), (ranked["length"] == table["length"]) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))).drop(table["length"])
    turn = F.col("_rank") - F.col("_from")
    placed = placed.withColumn("sequence_id", F.col("_base") + F.floor(turn / F.col("_each")).cast("long")).withColumn("offset", F.col("_at") + F.pmod(turn, F.col("_each")) * F.col("length"))
    return placed.drop("_salt", "_part", "_before", "_rank", "_from", "_to", "_each", "_base", "_at")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the bytes of each packed sequence, from rows that still carry ``ids``."""
    joined = F.aggregate("p", F.lit("").cast("binary"), lambda all_, x: F.concat(all_, x["ids"]))
    return packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p")).select("sequence_id", joined.alias("ids"))
