"""SentencePiece encoding over the piece lattice: Viterbi forward, A* backward for the n best, exact decoding."""

from __future__ import annotations

import hashlib
import heapq
from bisect import insort
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_long, codes, mix, slices, small_batches

#: How the format writes a space, the penalty of a character that no piece has, and the score that marks
#: a piece without an own one; such pieces (single spaces, runs of spaces) score a little below the lowest that has one.
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
NO_SCORE, NO_SCORE_PENALTY = -1e9, 5.0
#: Scores are whole numbers of this share of one, so that a sum does not depend on its order and ties are ties.
UNIT = 2.0**-20
#: The score of what cannot be reached.
NEVER = -(1 << 61)


class Encoder:
    """The pieces of a model file.

    Inside, a space byte stands for the model's space sign, so a space sign that the text itself has
    is an unknown character; unknown characters become byte pieces. A text begins with one added
    space. Among segmentations of equal score the one whose last piece starts first wins, from the end on.
    """

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.piece_bytes: list[bytes] = []
        self.byte_ids = np.zeros(256, dtype=np.int32)
        self.pieces: dict[bytes, int] = {}
        scores = np.zeros(n)
        for i in range(n):
            name = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(name[3:5], 16)
                self.byte_ids[value] = i
                self.piece_bytes.append(bytes([value]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.piece_bytes.append(b"" if sp.is_control(i) or sp.is_unknown(i) else name.replace(SPACE, " ").encode())
            else:
                own = name.replace(SPACE, " ").encode()
                self.piece_bytes.append(own)
                self.pieces[own] = i
                scores[i] = sp.get_score(i)
        used = np.array(list(self.pieces.values()))
        lowest = float(scores[used][scores[used] > NO_SCORE].min())
        fixed = lambda x: np.round(np.asarray(x) / UNIT).astype(np.int64)
        self.scores = fixed(np.where(scores > NO_SCORE, scores, lowest - NO_SCORE_PENALTY))
        self.unknown = int(fixed(lowest - UNKNOWN_PENALTY))
        self.longest = max(map(len, self.pieces))
        # inside[a, b]: some piece has byte a before byte b, so a chunk may not be cut there
        self.inside = np.zeros((256, 256), dtype=bool)
        for p in self.pieces:
            for a, b in zip(p, p[1:]):
                self.inside[a, b] = True
        self._index()

    def _index(self) -> None:
        """A trie of the pieces. Its steps are an open-addressed table: state and byte -> state, the root being state 0."""
        states = {b"": 0}
        for piece in self.pieces:
            for k in range(1, len(piece) + 1):
                states.setdefault(piece[:k], len(states))
        self.piece_at = np.full(len(states), -1, dtype=np.int32)
        self.goes_on = np.zeros(len(states), dtype=bool)
        steps = np.zeros(len(states) - 1, dtype=np.int64)
        for k, (own, state) in enumerate(states.items()):
            self.piece_at[state] = self.pieces.get(own, -1)
            if own:
                up = states[own[:-1]]
                self.goes_on[up] = True
                steps[k - 1] = up * 256 + own[-1]
        bits = int(np.ceil(np.log2(len(steps) * 3)))
        self.mask = np.int64((1 << bits) - 1)
        self.steps = np.full(1 << bits, -1, dtype=np.int64)
        self.next = np.zeros(1 << bits, dtype=np.int32)
        place = self._place(steps)
        left = np.arange(len(steps))
        while len(left):
            free = left[self.steps[place[left]] < 0]
            self.steps[place[free]] = steps[free]  # of several, one stays
            won = free[self.steps[place[free]] == steps[free]]
            self.next[place[won]] = won + 1
            left = left[self.steps[place[left]] != steps[left]]
            place[left] = (place[left] + 1) & self.mask

    def _place(self, steps: np.ndarray) -> np.ndarray:
        return (mix(steps.astype(np.uint64)) & np.uint64(self.mask)).astype(np.int64)

    def follow(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The states that bytes lead to, -1 where no piece goes on like that."""
        want = state.astype(np.int64) * 256 + byte
        at = self._place(want)
        out = np.full(len(want), -1, dtype=np.int32)
        live = np.arange(len(want))
        while len(live):
            place = at[live]
            have = self.steps[place]
            hit = have == want[live]
            out[live[hit]] = self.next[place[hit]]
            live = live[~hit & (have >= 0)]
            at[live] = (at[live] + 1) & self.mask
        return out

    # one chunk at a time

    def lattice(self, chunk: bytes) -> list[list[tuple[int, int, int]]]:
        """For each end the edges (start, id, score) that reach it, by rising start; id -1 is a character that no piece has."""
        n = len(chunk)
        into: list[list[tuple[int, int, int]]] = [[] for _ in range(n + 1)]
        scores = self.score_list
        steps = [self.pieces.get(chunk[i : i + 1], -2) for i in range(n)]
        for i in range(n):
            if chunk[i] & 0xC0 == 0x80:
                continue
            size = 1
            while i + size < n and chunk[i + size] & 0xC0 == 0x80:
                size += 1
            if (steps[i] if size == 1 else self.pieces.get(chunk[i : i + size], -2)) < 0:
                into[i + size].append((i, -1, self.unknown))
            for j in range(i + 1, min(n, i + self.longest) + 1):
                k = self.pieces.get(chunk[i:j])
                if k is not None:
                    into[j].append((i, k, scores[k]))
                elif chunk[i:j] not in self.prefixes:
                    break
        return into

    @cached_property
    def score_list(self) -> list[int]:
        return self.scores.tolist()

    @cached_property
    def prefixes(self) -> set[bytes]:
        return {p[:k] for p in self.pieces for k in range(1, len(p))}

    def ids_of(self, chunk: bytes, start: int, end: int, piece: int) -> list[int]:
        return [piece] if piece >= 0 else self.byte_ids[list(chunk[start:end])].tolist()

    @staticmethod
    def forward(into) -> list[int]:
        """The best score that reaches each place."""
        best = [0] + [NEVER] * (len(into) - 1)
        for j in range(1, len(into)):
            for start, _, score in into[j]:
                if best[start] > NEVER and best[start] + score > best[j]:
                    best[j] = best[start] + score
        return best

    def chunk_nbest(self, chunk: bytes, n: int) -> list[tuple[int, tuple[int, ...]]]:
        """The n best segmentations of a chunk, by A* from its end.

        A state is a suffix already segmented, with a pointer to the state it was made from. Its priority
        adds the Viterbi score of the rest, which is exactly what its best completion will have. So each
        queued state stands for a segmentation of its own with that score, and no more than the n best
        states need be queued; of equal ones the longer suffix goes first.
        """
        into = self.lattice(chunk)
        best = self.forward(into)
        made: list[tuple[int, int, int, int]] = []  # start, end, piece, the state before
        queue = [(-best[-1], len(chunk), 0, 0, -1)]
        count, out = 0, []
        while queue and len(out) < n:
            _, at, _, own, state = queue.pop(0)
            if not at:
                ids: list[int] = []
                while state >= 0:
                    start, end, piece, state = made[state]
                    ids += self.ids_of(chunk, start, end, piece)
                out.append((own, tuple(ids)))
                continue
            room = n - len(out)
            for start, piece, score in into[at]:
                if best[start] == NEVER:
                    continue
                f = -(own + score + best[start])
                if len(queue) >= room and (f, start) >= queue[-1][:2]:
                    continue
                count += 1
                made.append((start, at, piece, state))
                insort(queue, (f, start, count, own + score, len(made) - 1))
                del queue[room:]
        return out

    # many chunks at once

    def encode_batch(self, buf: np.ndarray, off: np.ndarray) -> Batch:
        return Batch(self, buf, off)

    def encode(self, text: str) -> list[int]:
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        return self.encode_batch(raw, np.array([0, len(raw)])).tokens.tolist()

    def nbest(self, text: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations of a whole text, best first."""
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        batch = self.encode_batch(raw, np.array([0, len(raw)]))
        out = []
        for score, changes in batch.nbest(0, n):
            ids: list[int] = []
            for c in range(batch.chunk_at[0], batch.chunk_at[1]):
                ids += changes[c] if c in changes else batch.chunk_tokens(c).tolist()
            out.append((score, ids))
        return out

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of the text that was encoded as ids."""
        return b"".join(map(self.piece_bytes.__getitem__, ids))[1:]


class Batch:
    """Texts cut into chunks that no piece crosses; each distinct chunk is searched once.

    tokens with token_at per text; per distinct chunk the best score and the loss of its second best.
    """

    def __init__(self, enc: Encoder, buf: np.ndarray, off: np.ndarray):
        self.enc = enc
        full = np.flatnonzero(np.diff(off))
        buf = np.insert(buf, off[full], 0x20) if len(full) else buf
        sizes = np.diff(off) + (np.diff(off) > 0)
        off = np.concatenate([[0], np.cumsum(sizes)])
        self.buf = buf
        cut = np.ones(len(buf), dtype=bool)
        if len(buf):
            cut[1:] = ~enc.inside[buf[:-1], buf[1:]] & (buf[1:] & 0xC0 != 0x80)
            cut[off[:-1][sizes > 0]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(buf)) if len(start) else start
        self.chunk_at = np.searchsorted(start, off)
        first, self.kind = codes(buf, start, end)
        self.start, self.end = start[first], end[first]
        n = self.end - self.start
        self.best, self.loss = np.zeros(len(n), dtype=np.int64), np.full(len(n), np.inf)
        counts = np.zeros(len(n), dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.int32)
        if len(n):
            u, step, ids = self._forward(n)
            order = np.lexsort((step, u))
            self.flat = ids[order].astype(np.int32)
            counts = np.bincount(u, minlength=len(n))
        self.flat_at = np.concatenate([[0], np.cumsum(counts)])
        own = counts[self.kind]
        self.place = np.concatenate([[0], np.cumsum(own)])
        self.tokens = self.flat[np.repeat(self.flat_at[self.kind] - self.place[:-1], own) + np.arange(self.place[-1])]
        self.token_at = self.place[self.chunk_at]

    def _edges(self, n: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, ...]:
        """Pieces in all chunks, shorter ones first: end within the chunk, source and target node, id (-1 for an unknown character), score."""
        enc = self.enc
        rel = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(self.start, n) + rel
        lead = self.buf[at] & 0xC0 != 0x80
        node, room = (np.repeat(base, n) + rel)[lead], (np.repeat(n, n) - rel)[lead]
        at, rel = at[lead], rel[lead]
        b = self.buf[at]
        width = np.minimum(np.where(b < 0x80, 1, np.where(b < 0xE0, 2, np.where(b < 0xF0, 3, 4))), room)
        single = np.zeros(len(at), dtype=bool)
        found = []
        live, state = np.arange(len(at)), np.zeros(len(at), dtype=np.int32)
        for size in range(1, enc.longest + 1):
            if not len(live):
                break
            state = enc.follow(state, self.buf[at[live] + size - 1])
            live, state = live[state >= 0], state[state >= 0]
            ids = enc.piece_at[state]
            hit = np.flatnonzero(ids >= 0)
            own = live[hit]
            found.append((own, np.full(len(own), size), ids[hit], enc.scores[ids[hit]]))
            single[own] |= width[own] == size
            more = enc.goes_on[state] & (room[live] > size)
            live, state = live[more], state[more]
        alone = np.flatnonzero(~single)
        found.append((alone, width[alone], np.full(len(alone), -1, dtype=np.int32), np.full(len(alone), enc.unknown)))
        p, size, ids, score = (np.concatenate(x) for x in zip(*found, strict=True))
        return rel[p] + size, node[p], node[p] + size, ids, score

    def _forward(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward Viterbi with a second best over all chunks, place by place; returns (chunk, order, id) of the best paths.

        The best paths are then walked from their ends. That is the A* search of rank one: its heuristic
        is exact, so the first state it takes from each place is on the best path, and it needs no queue.
        """
        base = np.concatenate([[0], np.cumsum(n + 1)])[:-1]  # a node for each place of each chunk
        nodes = int((n + 1).sum())
        level, source, target, ids, score = self._edges(n, base)
        order = np.argsort(level.astype(np.int16) if n.max() < 1 << 15 else level, kind="stable")
        source, target, ids, score = source[order], target[order], ids[order], score[order]
        cuts = np.searchsorted(level[order], np.arange(1, n.max() + 2)).tolist()
        best, second = np.full(nodes, NEVER), np.full(nodes, NEVER)
        by = np.full(nodes, -1, dtype=np.int64)
        best[base] = 0
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            s, t = source[a:z], target[a:z]
            new = best[s] + score[a:z]
            np.maximum.at(best, t, new)
            win = np.flatnonzero(new == best[t])
            by[t[win]] = win + a
            # of equal ones the longest piece is last, and stays; the others are second
            np.maximum.at(second, t, np.maximum(second[s] + score[a:z], NEVER))
            lost = by[t] != np.arange(a, z)
            np.maximum.at(second, t[lost], new[lost])
        end = base + n
        self.best = best[end]
        self.loss = np.where(second[end] > NEVER // 2, (best[end] - second[end]).astype(float), np.inf)
        out_u, out_step, out_id = [], [], []
        now, owner, step = end.copy(), np.arange(len(n)), 0
        offset = self.start - base  # of a node's place in the buffer
        while len(now):
            e = by[now]
            own = ids[e]
            known = own >= 0
            out_u.append(owner[known])
            out_step.append(np.full(known.sum(), step))
            out_id.append(own[known])
            if not known.all():
                size = now - source[e]
                for k in range(4):  # the bytes of unknown characters, last first
                    some = ~known & (size > k)
                    out_u.append(owner[some])
                    out_step.append(np.full(some.sum(), step - k))
                    out_id.append(self.enc.byte_ids[self.buf[now[some] + offset[owner[some]] - 1 - k]])
            step -= 4
            now = source[e]
            more = now > base[owner]
            now, owner = now[more], owner[more]
        return np.concatenate(out_u), np.concatenate(out_step), np.concatenate(out_id)

    def chunk_tokens(self, c: int) -> np.ndarray:
        u = self.kind[c]
        return self.flat[self.flat_at[u] : self.flat_at[u + 1]]

    def nbest(self, text: int, n: int) -> list[tuple[float, dict[int, list[int]]]]:
        """The n best segmentations of a text: the score of each, with the chunks (and their ids) in which it leaves the best one.

        A segmentation among the n best leaves the best one in at most n - 1 chunks, and those are of the
        n - 1 that lose least by their second best; only these are searched by A*.
        """
        a, b = int(self.chunk_at[text]), int(self.chunk_at[text + 1])
        if a == b:
            return [(0.0, {})]
        kinds = self.kind[a:b]
        top = int(self.best[kinds].sum())
        loss = self.loss[kinds]
        few = min(n - 1, len(loss))
        near = np.argpartition(loss, few - 1)[:few] if few else np.zeros(0, dtype=np.int64)
        if few:  # of equal losses the first in the text
            worst = loss[near].max()
            near = np.concatenate([np.flatnonzero(loss < worst), np.flatnonzero(loss == worst)])[:few]
        options = []
        for c in sorted(near[np.isfinite(loss[near])], key=lambda c: (loss[c], c)):
            u = kinds[c]
            options.append((int(a + c), self._search(int(u), n)))
        out, count = [], 0
        queue = [(0, 0, (0,) * len(options))]
        seen = {queue[0][2]}
        while queue and len(out) < n:
            cost, _, ranks = heapq.heappop(queue)
            out.append(((top - cost) * UNIT, {c: list(found[r][1]) for (c, found), r in zip(options, ranks, strict=True) if r}))
            for k, (_, found) in enumerate(options):
                if ranks[k] + 1 < len(found):
                    more = (*ranks[:k], ranks[k] + 1, *ranks[k + 1 :])
                    if more not in seen:
                        seen.add(more)
                        count += 1
                        heapq.heappush(queue, (cost + found[ranks[k]][0] - found[ranks[k] + 1][0], count, more))
        return out

    def edits(self, text: int, changes: dict[int, list[int]]) -> list[dict]:
        """A segmentation as edits of the best one: from token `at` of the text on, n tokens are `ids` instead."""
        first = int(self.place[self.chunk_at[text]])
        return [{"at": int(self.place[c]) - first, "n": int(self.place[c + 1] - self.place[c]), "ids": ids} for c, ids in sorted(changes.items())]

    def _search(self, u: int, n: int) -> list[tuple[int, tuple[int, ...]]]:
        self.searched = getattr(self, "searched", {})
        if u not in self.searched:
            self.searched[u] = self.enc.chunk_nbest(bytes(self.buf[self.start[u] : self.end[u]]), n)
        return self.searched[u]


@lru_cache(maxsize=2)
def load(path: str) -> Encoder:
    return Encoder(path)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def edited(ids: list[int], edits: list) -> list[int]:
    """The whole segmentation that edits make of the best one."""
    out, at = [], 0
    for e in edits:
        out += [*ids[at : e["at"]], *e["ids"]]
        at = e["at"] + e["n"]
    return [*out, *ids[at:]]


def encode(docs: DataFrame, model: str | None = None, n: int = 4) -> DataFrame:
    """doc_id, n_tokens, ids, nbest, nbest_scores, ids_sha256, round_trip for each row of docs.

    ids is the best segmentation. nbest has the n best ones, best first (fewer where a text has fewer): the
    score of each and its edits of ids, which edited() applies. nbest_scores are their scores, ids_sha256 of the ids
    as little-endian 32-bit numbers, round_trip whether ids decode to the very bytes of the
    text. Null and empty texts have no tokens and one segmentation, of score 0. Any characters are
    encoded, unknown ones as bytes. An empty table gives no rows. Other columns are not looked at.
    model: path of a model file that every executor has; by default that of the installed package.
    """
    edit = pa.struct([("at", pa.int32()), ("n", pa.int32()), ("ids", pa.list_(pa.int32()))])
    kind = pa.list_(pa.struct([("score", pa.float64()), ("edits", pa.list_(edit))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = load(model or default_model())
        for b, buf, off in slices(batches, most=1 << 19):
            found = enc.encode_batch(buf, off)
            at = found.token_at
            best, digest, same = [], [], []
            ids = found.tokens.tolist()
            for d in range(b.num_rows):
                best.append([{"score": s, "edits": found.edits(d, changes)} for s, changes in found.nbest(d, n)])
                digest.append(hashlib.sha256(found.tokens[at[d] : at[d + 1]].tobytes()).hexdigest())
                same.append(enc.decode(ids[at[d] : at[d + 1]]) == buf[off[d] : off[d + 1]].tobytes())
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(found.tokens))
            scores = pa.array([[x["score"] for x in own] for own in best], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), as_long(np.diff(at)), lists, pa.array(best, kind), scores, pa.array(digest, pa.string()), pa.array(same, pa.bool_())], names=["doc_id", "n_tokens", "ids", "nbest", "nbest_scores", "ids_sha256", "round_trip"])

    small_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids array<int>, nbest array<struct<score: double, edits: array<struct<at: int, n: int, ids: array<int>>>>>, nbest_scores array<double>, ids_sha256 string, round_trip boolean"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, ids) -> (doc_id, text); null ids give a null text, ids that are no text's give replacement signs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = load(model or default_model())
        for b in batches:
            texts = [None if x is None else enc.decode(x).decode(errors="replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", F.col("ids")).mapInArrow(run, "doc_id long, text string")
