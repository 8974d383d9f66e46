"""Substring deduplication over word windows with a count-min prefilter.

First every block of documents sketches its windows: for each row of the sketch the sorted cells it touches, and whether more than once.
The sketches are merged by ranges of cells; a merged cell counts at least what any of its windows does. Each block learns which of
its cells count two or more, and only windows for which all rows say so are grouped exactly, by 128-bit digests: a block sends each
such digest once, and learns whether an earlier block has it. Blocks follow the ids, so an earlier block is an earlier occurrence.
The sketch's width follows the input's size, so its errors do not grow with the input. No window that repeats is ever lost.
"""

from __future__ import annotations

from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK_BYTES, bits, blocked, flags, in_order, pack, shard_edges, spread, unpack
from .common import written

WINDOW = 20
DEPTH = 2
SHARD_KEYS = 2 << 20
_BASE = 0x9E3779B97F4A7C15


def digests(words: list[bytes], ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(places where a window of one document starts, its two 64-bit digests) for the documents' words, one after the other.

    A window's digest is a polynomial in its words' 128-bit digests, from running sums.
    """
    n = len(words)
    starts = np.concatenate(([0], ends[:-1]))
    inside = np.repeat(ends - window, ends - starts) >= np.arange(n)
    places = np.flatnonzero(inside)
    if not len(places):
        return places, np.zeros((2, 0), np.uint64)
    digest = xxhash.xxh3_128_digest
    pairs = np.frombuffer(b"".join(map(digest, words)), "<u8").reshape(-1, 2)
    out = []
    for lane, base in enumerate((_BASE, _BASE ^ 0x5851F42D4C957F2C)):
        base |= 1
        powers = np.ones(n, np.uint64)
        powers[1:] = base
        np.multiply.accumulate(powers, out=powers)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(pairs[:, lane] * powers, dtype=np.uint64)))
        back = np.ones(n, np.uint64)
        back[1:] = pow(base, -1, 1 << 64)
        np.multiply.accumulate(back, out=back)
        out.append(spread((sums[places + window] - sums[places]) * back[places]))
    return places, np.stack(out)


class Plan:
    """What every pass must agree on."""

    def __init__(self, n_bytes: int, window: int, depth: int):
        about = max(n_bytes // 6, 1)  # windows, by the usual length of a word; only the sketch's size depends on it
        self.window, self.depth = window, depth
        self.cell_bits = max(12, ceil(log2(8 * about / depth)))
        self.shard_bits = min(self.cell_bits - 8, max(3, ceil(log2(about / SHARD_KEYS))))
        if self.cell_bits - self.shard_bits > 32:
            self.shard_bits = self.cell_bits - 32

    def survey(self, table: pa.Table):
        """(words, ends of the documents, window places, digests) of a block."""
        words: list[bytes] = []
        ends = []
        for t in table.column("text"):
            words += t.as_py().encode().split()
            ends.append(len(words))
        ends = np.array(ends, np.int64)
        return words, ends, *digests(words, ends, self.window)

    def cells(self, keys: np.ndarray, row: int) -> np.ndarray:
        return keys[row % 2] >> np.uint64(64 - self.cell_bits) if row < 2 else spread(keys[row % 2] + np.uint64(row)) >> np.uint64(64 - self.cell_bits)

    def sketch(self, table: pa.Table) -> pa.Table:
        table = in_order(table)
        block = table.column("block")[0].as_py()
        _, _, _, keys = self.survey(table)
        out = {"part": [], "block": [], "n": [], "cells": [], "twice": []}
        for row in range(self.depth):
            cells = np.sort(self.cells(keys, row))
            new = np.concatenate(([True], cells[1:] != cells[:-1]))[: len(cells)]
            at = np.flatnonzero(new)
            own, count = cells[at], np.diff(np.append(at, len(cells)))
            edges = shard_edges(own << np.uint64(64 - self.cell_bits), self.shard_bits)
            low = np.uint64((1 << (self.cell_bits - self.shard_bits)) - 1)
            for shard in np.flatnonzero(np.diff(edges)):
                a, b = edges[shard], edges[shard + 1]
                out["part"].append((row << self.shard_bits) + int(shard))
                out["block"].append(block)
                out["n"].append(b - a)
                out["cells"].append(pack(own[a:b] & low))
                out["twice"].append(bits(count[a:b] > 1))
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))})

    def merge(self, table: pa.Table) -> pa.Table:
        """A range of cells: adds the blocks' counts, up to two, and answers each block."""
        total = np.zeros(1 << (self.cell_bits - self.shard_bits), np.uint8)
        for n, cells, twice in zip(*(table.column(c).to_pylist() for c in ("n", "cells", "twice"))):
            at = unpack(cells)
            total[at] = np.minimum(total[at] + 1 + flags(twice, n), 2)
        answers = [bits(total[unpack(cells)] > 1) for cells in table.column("cells").to_pylist()]
        return pa.table({"part": table.column("part"), "block": table.column("block"), "answer": pa.array(answers, pa.binary())})

    def suspects(self, keys: np.ndarray, answers: pa.Table) -> np.ndarray:
        """Which windows every row of the sketch estimates at two or more."""
        said = dict(zip(answers.column("part").to_pylist(), answers.column("answer").to_pylist()))
        out = np.ones(keys.shape[1], bool)
        for row in range(self.depth):
            cells = self.cells(keys, row)
            order = np.argsort(cells)
            ranked = cells[order]
            new = np.concatenate(([True], ranked[1:] != ranked[:-1]))[: len(ranked)]
            edges = shard_edges(ranked[new] << np.uint64(64 - self.cell_bits), self.shard_bits)
            often = [flags(said[(row << self.shard_bits) + int(s)], int(edges[s + 1] - edges[s])) for s in np.flatnonzero(np.diff(edges))]
            if often:
                mine = np.empty(len(cells), bool)
                mine[order] = np.concatenate(often)[np.cumsum(new) - 1]
                out &= mine
        return out

    def firsts(self, keys: np.ndarray, suspect: np.ndarray):
        """(suspect windows sorted by digest then place, whether each is the block's first of its digest)."""
        at = np.flatnonzero(suspect)
        at = at[np.lexsort((at, keys[1][at], keys[0][at]))]
        new = np.ones(len(at), bool)
        new[1:] = (keys[0][at[1:]] != keys[0][at[:-1]]) | (keys[1][at[1:]] != keys[1][at[:-1]])
        return at, new

    def candidates(self, table: pa.Table, answers: pa.Table) -> pa.Table:
        out = {"part": [], "block": [], "keys": []}
        if table.num_rows:
            table = in_order(table)
            _, _, _, keys = self.survey(table)
            at, new = self.firsts(keys, self.suspects(keys, answers))
            mine = keys[:, at[new]]
            edges = shard_edges(mine[0], self.shard_bits)
            for shard in np.flatnonzero(np.diff(edges)):
                out["part"].append(int(shard))
                out["block"].append(table.column("block")[0].as_py())
                out["keys"].append(mine[:, edges[shard] : edges[shard + 1]].tobytes())
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), (pa.int32(), pa.int32(), pa.binary()))})

    def group(self, table: pa.Table) -> pa.Table:
        """A range of digests: which of a block's digests an earlier block has too."""
        blocks = table.column("block").to_numpy()
        each = [np.frombuffer(k, np.uint64).reshape(2, -1) for k in table.column("keys").to_pylist()]
        keys = np.concatenate(each, axis=1)
        owner = np.repeat(blocks, [k.shape[1] for k in each])
        order = np.lexsort((owner, keys[1], keys[0]))
        seen = np.zeros(len(order), bool)
        seen[order[1:]] = (keys[0][order[1:]] == keys[0][order[:-1]]) & (keys[1][order[1:]] == keys[1][order[:-1]])
        ends = np.cumsum([k.shape[1] for k in each])
        answers = [bits(x) for x in np.split(seen, ends[:-1])]
        return pa.table({"part": pa.array(-1 - table.column("part").to_numpy(), pa.int32()), "block": table.column("block"), "answer": pa.array(answers, pa.binary())})

    def clean(self, table: pa.Table, answers: pa.Table) -> pa.Table:
        kinds = {"given": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept": pa.string()}
        if not table.num_rows:
            return pa.table({k: pa.array([], t) for k, t in kinds.items()})
        table = in_order(table)
        words, ends, places, keys = self.survey(table)
        at, new = self.firsts(keys, self.suspects(keys, answers))
        said = {-1 - p: a for p, a in zip(answers.column("part").to_pylist(), answers.column("answer").to_pylist()) if p < 0}
        edges = shard_edges(keys[0][at[new]], self.shard_bits)
        earlier = [flags(said[int(s)], int(edges[s + 1] - edges[s])) for s in np.flatnonzero(np.diff(edges))]
        again = ~new
        if earlier:
            again[new] = np.concatenate(earlier)
        steps = np.zeros(len(words) + 1, np.int64)
        hit = places[at[again]]
        np.add.at(steps, hit, 1)
        np.add.at(steps, hit + self.window, -1)
        covered = np.cumsum(steps)[:-1] > 0
        starts = np.concatenate(([0], ends[:-1]))
        kept, removed = [], []
        for a, b in zip(starts.tolist(), ends.tolist()):
            gone = covered[a:b]
            n = int(gone.sum())
            removed.append(n)
            kept.append(b" ".join(words[a:b] if not n else [words[a + i] for i in np.flatnonzero(~gone)]).decode())
        values = (table.column("given"), pa.array(ends - starts), pa.array(removed, pa.int64()), pa.array(kept, pa.string()))
        return pa.table(dict(zip(kinds, values)))


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW, depth: int = DEPTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """given (the id), n_words, n_removed, kept (the kept words joined by one space) of each row.

    Every word covered by a window whose words also start earlier (smaller id; in one document, an earlier start) goes. NULL texts have no words;
    NULL ids come last; rows of one id are ordered by text. Texts shorter than a window keep all words. Other columns are not read.
    """
    own = blocked(docs, id_column, text_column, block_bytes)
    plan = Plan(own.n_bytes, window, depth)
    rows = own.docs.groupBy("block")
    sketches = rows.applyInArrow(lambda t: plan.sketch(t), "part int, block int, n int, cells binary, twice binary")
    often = written(sketches.groupBy("part").applyInArrow(lambda t: plan.merge(t), "part int, block int, answer binary"), "sketch_answers")
    digest_parts = rows.cogroup(often.groupBy("block")).applyInArrow(lambda t, answers: plan.candidates(t, answers), "part int, block int, keys binary")
    earlier = written(digest_parts.groupBy("part").applyInArrow(lambda t: plan.group(t), "part int, block int, answer binary"), "group_answers")
    answers = often.unionByName(earlier)
    return rows.cogroup(answers.groupBy("block")).applyInArrow(lambda t, answers: plan.clean(t, answers), "given long, n_words long, n_removed long, kept string")


def substring_report(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row."""
    out = remove_repeats(docs, id_column, text_column)
    return out.select(F.col("given").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
