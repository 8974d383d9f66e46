"""Substring deduplication on bytes by sorting the strings that can repeat.

Every string of LENGTH bytes has an anchor: the leftmost gram of least hash among those it holds. Equal strings have equal anchors at
equal offsets, so only strings that share an anchor need comparing. The strings of one anchor occurrence overlap and lie in one short
span. Each block of documents sends its anchors and the digests of their spans; equal spans repeat as wholes, and no text is moved for them.
Only spans whose anchor also occurs in another span are sent as text; there the strings are sorted and neighbours compared byte by byte.

Sorting all suffixes by induction with queues on disk would need at least 16 bytes a suffix, some 28 times the input; see the README.
"""

from __future__ import annotations

from functools import lru_cache
from math import ceil, log2

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import bits, blocked, flags, in_order, shard_edges, spread
from .common import written

LENGTH = 200
GRAM = 64
BLOCK_BYTES = 2 << 20
#: Answers to a span: nothing shares its anchor; it repeats as a whole; it does and is also needed as text; it must be compared.
ALONE, WHOLE, WHOLE_SENT, OPEN = range(4)


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


@lru_cache(maxsize=4)
def _letters(seed: int) -> np.ndarray:
    return spread(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def running(data: np.ndarray, lane: int) -> tuple[np.ndarray, np.ndarray]:
    """(running sums, inverse powers) from which any substring's 64-bit polynomial digest follows."""
    base = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)[lane]
    room = 1 << max(16, int(len(data)).bit_length())  # few sizes, so that the powers are kept
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_letters(lane)[data] * _powers(base, room)[: len(data)], out=sums[1:])
    return sums, _powers(pow(base, -1, 1 << 64), room)


class Spans:
    """The anchors of a block: window starts and their anchors, in runs of one anchor each."""

    def __init__(self, texts: list[bytes], length: int, gram: int):
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.ends = np.cumsum(np.array(list(map(len, texts)), np.int64))
        n, width = len(self.data), length - gram + 1
        room = np.zeros(n, bool)
        step = np.zeros(n + 1, np.int64)
        for a, b in zip(np.concatenate(([0], self.ends[:-1])), self.ends):
            if b - a >= length:
                step[a] += 1
                step[b - length + 1] -= 1
        room = np.cumsum(step[:-1]) > 0
        self.lo = self.hi = self.at = np.zeros(0, np.int64)
        self.hash = self.one = self.two = np.zeros(0, np.uint64)
        if not room.any():
            return
        sums, back = running(self.data, 0)
        grams = spread((sums[gram:] - sums[:-gram]) * back[: n - gram + 1])
        # a gram's leading bits above its place: the least of some is the least gram, the leftmost of equal ones
        least = grams & np.uint64(0xFFFFFFFF00000000) | np.arange(len(grams), dtype=np.uint64)
        reach = 1
        while reach < width:  # least of the next `reach` places, doubled until it spans the window
            move = min(reach, width - reach)
            least = np.minimum(least[move:], least[:-move])
            reach += move
        starts = np.flatnonzero(room)
        own = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.ones(len(starts), bool)
        new[1:] = (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(starts)) - 1
        self.lo, self.hi, self.at = starts[first], starts[last], own[first]
        self.hash = spread(grams[self.at] + np.uint64(1))  # least grams crowd near zero; scrambled, they deal evenly to shards
        size = (self.hi - self.lo + length).astype(np.uint64)
        offset = (self.at - self.lo).astype(np.uint64)
        mark = spread(size << np.uint64(32) | offset)
        two, back2 = running(self.data, 1)
        span_end = self.hi + length
        self.one = spread((sums[span_end] - sums[self.lo]) * back[self.lo]) ^ mark
        self.two = spread((two[span_end] - two[self.lo]) * back2[self.lo]) + mark
        # by anchor, then span; one entry for equal spans of the block
        self.order = np.lexsort((self.lo, self.two, self.one, self.hash))
        h, a, b = (x[self.order] for x in (self.hash, self.one, self.two))
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        self.entry = np.flatnonzero(fresh)
        self.entry_of = np.cumsum(fresh) - 1
        self.count = np.diff(np.append(self.entry, len(h)))
        self.keys = np.stack([h[self.entry], a[self.entry], b[self.entry]])


def ranked(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """A number for each string at ``starts``, equal for equal strings: suffix ranks by prefixes of 8, 16, 32 ... bytes, then of two that overlap to ``length``."""
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    key = np.zeros(len(text), np.uint64)
    for i in range(8):
        key |= padded[i : i + len(text)].astype(np.uint64) << np.uint64(8 * i)
    reach = 8
    while True:
        rank = np.unique(key, return_inverse=True)[1].astype(np.uint64)
        if 2 * reach > length:
            return rank[starts] << np.uint64(32) | rank[starts + length - reach]
        key = rank << np.uint64(32)
        key[:-reach] |= rank[reach:]
        reach *= 2


def repeated(text: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which of the strings of ``length`` at ``starts`` occur at two starts or more.

    The strings are put in the order of their digests, and neighbours of one digest are compared byte by byte. Should two
    of them differ all the same, suffix ranks decide instead.
    """
    if len(starts) < 2:
        return np.zeros(len(starts), bool)
    digest = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # a digest does not depend on where its string stands, so a stretch of text at a time will do
        upto = max(at + 1, int(np.searchsorted(starts, starts[at] + (1 << 19))))
        near = starts[at:upto] - starts[at]
        sums, back = running(text[starts[at] : starts[upto - 1] + length], 0)
        digest[at:upto] = spread((sums[near + length] - sums[near]) * back[near])
        at = upto
    order = np.argsort(digest)
    digest = digest[order]
    pairs = np.flatnonzero(digest[1:] == digest[:-1])
    windows = np.lib.stride_tricks.sliding_window_view(text, length)
    out = np.zeros(len(starts), bool)
    for at in range(0, len(pairs), 1 << 15):
        left, right = order[pairs[at : at + (1 << 15)]], order[pairs[at : at + (1 << 15)] + 1]
        if not (windows[starts[left]] == windows[starts[right]]).all():
            key = ranked(text, starts, length)
            _, of, count = np.unique(key, return_inverse=True, return_counts=True)
            return count[of] > 1
        out[left] = out[right] = True
    return out


class Plan:
    def __init__(self, n_bytes: int, length: int, gram: int):
        if not 16 <= gram <= length:
            raise ValueError("a gram of 16 bytes or more, within the length, is needed")
        self.length, self.gram = length, gram
        self.shard_bits = max(3, ceil(log2(max(n_bytes, 1) / (8 << 20))))

    def spans(self, table: pa.Table) -> Spans:
        return Spans([t.as_py().encode() for t in table.column("text")], self.length, self.gram)

    def anchors(self, table: pa.Table) -> pa.Table:
        own = self.spans(in_order(table))
        out = {"part": [], "block": [], "keys": [], "twice": []}
        if len(own.lo):
            edges = shard_edges(own.keys[0], self.shard_bits)
            for s in np.flatnonzero(np.diff(edges)):
                a, b = edges[s], edges[s + 1]
                out["part"].append(int(s))
                out["block"].append(table.column("block")[0].as_py())
                out["keys"].append(own.keys[:, a:b].tobytes())
                out["twice"].append(bits(own.count[a:b] > 1))
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))})

    def judge(self, table: pa.Table) -> pa.Table:
        """A range of anchors: an answer for each span a block has sent; of equal spans the lowest block sends the text."""
        blocks = table.column("block").to_numpy()
        each = [np.frombuffer(k, np.uint64).reshape(3, -1) for k in table.column("keys").to_pylist()]
        sizes = [k.shape[1] for k in each]
        h, a, b = np.concatenate(each, axis=1)
        twice = np.concatenate([flags(x, n) for x, n in zip(table.column("twice").to_pylist(), sizes)])
        owner = np.repeat(blocks, sizes)
        order = np.lexsort((owner, b, a, h))
        hs, as_, bs = h[order], a[order], b[order]
        anchor = np.ones(len(order), bool)
        anchor[1:] = hs[1:] != hs[:-1]
        kind = anchor.copy()
        kind[1:] |= (as_[1:] != as_[:-1]) | (bs[1:] != bs[:-1])
        kind_of, anchor_of = np.cumsum(kind) - 1, np.cumsum(anchor) - 1
        many = np.bincount(kind_of, 1 + twice[order]) > 1
        kinds = np.bincount(anchor_of[kind])
        lone = np.bincount(anchor_of[kind], ~many) > 0
        text_needed = (kinds > 1) & lone
        said = np.where(many[kind_of], np.where(text_needed[anchor_of] & kind, WHOLE_SENT, WHOLE), np.where(text_needed[anchor_of], OPEN, ALONE))
        answer = np.empty(len(order), np.uint8)
        answer[order] = said
        packed = [zstandard.ZstdCompressor(level=1).compress(x.tobytes()) for x in np.split(answer, np.cumsum(sizes)[:-1])]
        return pa.table({"part": table.column("part"), "block": table.column("block"), "answer": pa.array(packed, pa.binary())})

    def told(self, own: Spans, answers: pa.Table) -> np.ndarray:
        """The answer to each of the block's entries."""
        said = {p: a for p, a in zip(answers.column("part").to_pylist(), answers.column("answer").to_pylist()) if p >= 0}
        edges = shard_edges(own.keys[0], self.shard_bits)
        return np.concatenate([np.frombuffer(zstandard.ZstdDecompressor().decompress(said[int(s)]), np.uint8) for s in np.flatnonzero(np.diff(edges))])

    def sent(self, own: Spans, told: np.ndarray):
        """(entries sent as text, their starts, their numbers of strings), in the entries' order."""
        entries = np.flatnonzero((told == OPEN) | (told == WHOLE_SENT))
        span = own.order[own.entry[entries]]
        return entries, own.lo[span], own.hi[span] - own.lo[span] + 1

    def texts(self, table: pa.Table, answers: pa.Table) -> pa.Table:
        out = {"part": [], "block": [], "counts": [], "text": []}
        if table.num_rows:
            own = self.spans(in_order(table))
            if len(own.lo):
                entries, lo, n = self.sent(own, self.told(own, answers))
                edges = shard_edges(own.keys[0][entries], self.shard_bits)
                for s in np.flatnonzero(np.diff(edges)):
                    a, b = edges[s], edges[s + 1]
                    out["part"].append(int(s))
                    out["block"].append(table.column("block")[0].as_py())
                    out["counts"].append(n[a:b].astype(np.int64).tobytes())
                    body = b"".join(own.data[i : i + k + self.length - 1].tobytes() for i, k in zip(lo[a:b].tolist(), n[a:b].tolist()))
                    out["text"].append(zstandard.ZstdCompressor(level=1).compress(body))
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))})

    def compare(self, table: pa.Table) -> pa.Table:
        counts = [np.frombuffer(c, np.int64) for c in table.column("counts").to_pylist()]
        text = np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(t) for t in table.column("text").to_pylist()), np.uint8)
        n = np.concatenate(counts)
        size = n + self.length - 1
        begin = np.cumsum(size) - size
        starts = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
        again = repeated(text, starts, self.length)
        each = np.split(again, np.cumsum([c.sum() for c in counts])[:-1])
        return pa.table({"part": pa.array(-1 - table.column("part").to_numpy(), pa.int32()), "block": table.column("block"), "answer": pa.array([bits(x) for x in each], pa.binary())})

    def clean(self, table: pa.Table, answers: pa.Table) -> pa.Table:
        kinds = {"given": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept": pa.binary()}
        if not table.num_rows:
            return pa.table({k: pa.array([], t) for k, t in kinds.items()})
        table = in_order(table)
        own = self.spans(table)
        step = np.zeros(len(own.data) + 1, np.int64)
        if len(own.lo):
            told = self.told(own, answers)
            whole = own.order[np.isin(told, (WHOLE, WHOLE_SENT))[own.entry_of]]
            np.add.at(step, own.lo[whole], 1)
            np.add.at(step, own.hi[whole] + self.length, -1)
            entries, lo, n = self.sent(own, told)
            compared = {-1 - p: a for p, a in zip(answers.column("part").to_pylist(), answers.column("answer").to_pylist()) if p < 0}
            edges = shard_edges(own.keys[0][entries], self.shard_bits)
            for s in np.flatnonzero(np.diff(edges)):
                a, b = edges[s], edges[s + 1]
                again = flags(compared[int(s)], int(n[a:b].sum()))
                starts = (np.repeat(lo[a:b] - (np.cumsum(n[a:b]) - n[a:b]), n[a:b]) + np.arange(n[a:b].sum()))[again]
                np.add.at(step, starts, 1)
                np.add.at(step, starts + self.length, -1)
        gone = np.cumsum(step[:-1]) > 0
        begin = np.concatenate(([0], own.ends[:-1]))
        removed, runs, kept = [], [], []
        for a, b in zip(begin.tolist(), own.ends.tolist()):
            g = gone[a:b]
            removed.append(int(g.sum()))
            runs.append(int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()))
            kept.append(own.data[a:b][~g].tobytes())
        values = (table.column("given"), pa.array(own.ends - begin), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary()))
        return pa.table(dict(zip(kinds, values)))


def remove_repeated_bytes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """given (the id), n_bytes, n_removed, n_spans, kept (the bytes left) of each row.

    Every byte covered by a string of ``length`` bytes that also starts elsewhere, in any document, goes. NULL texts are empty; shorter texts stay
    whole; rows of one id and text are copies of each other and go like others. Other columns are not read.
    """
    own = blocked(docs, id_column, text_column, block_bytes)
    plan = Plan(own.n_bytes, length, gram)
    rows = own.docs.groupBy("block")
    anchors = rows.applyInArrow(lambda t: plan.anchors(t), "part int, block int, keys binary, twice binary")
    judged = written(anchors.groupBy("part").applyInArrow(lambda t: plan.judge(t), "part int, block int, answer binary"), "anchor_answers")
    texts = rows.cogroup(judged.groupBy("block")).applyInArrow(lambda t, a: plan.texts(t, a), "part int, block int, counts binary, text binary")
    compared = written(texts.groupBy("part").applyInArrow(lambda t: plan.compare(t), "part int, block int, answer binary"), "suffix_answers")
    answers = judged.unionByName(compared)
    return rows.cogroup(answers.groupBy("block")).applyInArrow(lambda t, a: plan.clean(t, a), "given long, n_bytes long, n_removed long, n_spans long, kept binary")


def suffix_report(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row."""
    out = remove_repeated_bytes(docs, id_column, text_column)
    return out.select(F.col("given").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
