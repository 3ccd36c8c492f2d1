"""SentencePiece encoding to the N best segmentations, and decoding.

The pieces of a text form a lattice. A forward Viterbi pass gives the best score from the start to
every position; a backward A-star search from the end uses it as its heuristic. As it is exact, the
search pops complete segmentations in order of score, and N pops are the N best.

No piece of a SentencePiece vocabulary of this kind has its blank mark after another character, so the
lattice falls apart before each run of blanks, and distinct words are solved once a worker. The forward
pass runs over many words at a time: all of them walk one trie of the pieces, and the arcs of equal
start and length update the best and the second-best score of their ends together. The search along an
exact heuristic that is asked for one segmentation only follows the best arcs back, so that is all that
most words need. The N best of a text follow from those of its words: only the N - 1 words that lose
least by their second segmentation can differ from the best one, and those are searched by A-star.
Scores are those of the model file; a character without a piece becomes its bytes, at a score below
every piece's.

The score of a segmentation is the sum of its pieces' scores, so for a model trained by merges the
best one may differ from the library's own greedy result; it never scores less. Of equal scores the
one whose last pieces are longest goes first.

Defined results: a null or empty text has no pieces, score 0 and one segmentation; a text that holds
the blank mark itself decodes to a blank there (``exact`` is false), as in the library; repeated
rows give repeated results; an empty table gives no rows; other columns are left out. A word longer
than ``VECTOR`` is solved by itself, in time and memory in proportion to its length.
"""

from __future__ import annotations

import heapq
import zlib
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliogrid.llm.common import map_arrow
from heliogrid.llm.tokens import batches

BLANK = "▁"
N_BEST = 4
#: Words kept by one Python worker; about 300 bytes each.
MEMO = 300_000
#: Longest word of the common forward pass, and characters that go through it at a time.
VECTOR = 64
CHUNK = 1 << 18
#: Characters of text that are encoded at a time.
BATCH = 2 << 20
#: Letters with a dense row of transitions a state.
DENSE = 128


class Lattice:
    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        size = m.get_piece_size()
        names = [m.id_to_piece(i) for i in range(size)]
        special = [m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i) for i in range(size)]
        self.pieces = {p: (i, m.get_score(i)) for i, p in enumerate(names) if not special[i]}
        if any(BLANK in p.lstrip(BLANK) for p in self.pieces):
            raise ValueError("a piece runs over a word edge; the lattice can't be cut there")
        self.longest = max(map(len, self.pieces))
        if self.longest >= 32:
            raise ValueError("a piece of 32 or more characters; the arcs' keys have five bits for its length")
        self.byte_ids = {int(names[i][3:5], 16): i for i in range(size) if m.is_byte(i)}
        # pieces at -1e9 stand outside the model's ranking
        self.unknown = min(s for _, s in self.pieces.values() if s > -1e9) - 10.0
        as_byte = {i: bytes([b]) for b, i in self.byte_ids.items()}
        self.texts = [as_byte.get(i, b"" if special[i] else names[i].replace(BLANK, " ").encode()) for i in range(size)]
        self._build_trie()
        # of every word met: its number, and by number ids, text, score and loss of the second segmentation
        self.memo: dict[str, int] = {}
        self.raw: list[bytes] = []
        self.plain: list[bytes] = []
        self.score, self.loss = np.zeros(0), np.zeros(0)
        self.deep: dict[tuple[str, int], list[tuple[float, bytes]]] = {}

    def _build_trie(self) -> None:
        """States are prefixes of pieces, those that go on first; transitions by letter number."""
        letters = [c for c, _ in Counter(chain.from_iterable(self.pieces)).most_common()]
        self.letter = np.zeros(0x110000, np.int32)  # 0: in no piece
        self.letter[list(map(ord, letters))] = np.arange(1, len(letters) + 1)
        inner = sorted({p[:k] for p in self.pieces for k in range(len(p))})
        self.n_inner = len(inner)
        state = {p: k for k, p in enumerate(inner)}
        for p in self.pieces:
            state.setdefault(p, len(state))
        self.dense = np.full((self.n_inner, DENSE), -1, np.int32)
        rare: list[tuple[int, int]] = []
        for p, k in state.items():
            if p:
                before, c = state[p[:-1]], int(self.letter[ord(p[-1])])
                if c < DENSE:
                    self.dense[before, c] = k
                else:
                    rare.append((before << 32 | c, k))
        rare.sort()
        self.rare_keys = np.array([x for x, _ in rare] or [-1], np.int64)
        self.rare_next = np.array([k for _, k in rare] or [-1], np.int32)
        self.piece_of = np.full(len(state), -1, np.int32)
        self.score_of = np.zeros(len(state))
        for p, (i, score) in self.pieces.items():
            self.piece_of[state[p]], self.score_of[state[p]] = i, score

    def _follow(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The state after each letter, -1 if there is none."""
        out = np.full(len(state), -1, np.int32)
        often = letter < DENSE
        out[often] = self.dense[state[often], letter[often]]
        seldom = np.flatnonzero(~often)
        if len(seldom):
            key = state[seldom].astype(np.int64) << 32 | letter[seldom]
            at = np.minimum(np.searchsorted(self.rare_keys, key), len(self.rare_keys) - 1)
            out[seldom] = np.where(self.rare_keys[at] == key, self.rare_next[at], -1)
        return out

    def _arcs_of_all(self, letters: np.ndarray, at: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, ...]:
        """(start, length, piece, score) of all arcs, by offset of the start in its word, then length."""
        starts, offsets, lengths, pieces, scores = [], [], [], [], []

        def add(s: np.ndarray, o: np.ndarray, n: int, piece: np.ndarray, score: np.ndarray) -> None:
            for x, y in zip((starts, offsets, lengths, pieces, scores), (s, o, np.full(len(s), n, np.int32), piece, score)):
                x.append(y)

        lone = np.ones(len(letters), bool)
        s, o, state = at, offset, np.zeros(len(at), np.int32)
        for n in range(1, self.longest + 1):
            state = self._follow(state, letters[s + (n - 1)])
            ok = state >= 0
            s, o, state = s[ok], o[ok], state[ok]
            hit = self.piece_of[state] >= 0
            add(s[hit], o[hit], n, self.piece_of[state[hit]], self.score_of[state[hit]])
            if n == 1:
                lone[s[hit]] = False
            more = state < self.n_inner
            s, o, state = s[more], o[more], state[more]
            if not len(s):
                break
        bare = lone[at]  # a character without a piece
        add(at[bare], offset[bare], 1, np.full(int(bare.sum()), -1, np.int32), np.full(int(bare.sum()), self.unknown))
        start, off, length, piece, score = map(np.concatenate, (starts, offsets, lengths, pieces, scores))
        key = (off * 32 + length).astype(np.int16)
        order = np.argsort(key, kind="stable")
        return key[order], start[order], length[order], piece[order], score[order]

    def _solve(self, words: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Ids, score and loss of the second segmentation of short words: one forward pass over all."""
        lens = np.fromiter(map(len, words), np.int32, len(words))
        flat = np.frombuffer(("\n".join(words) + "\n").encode("utf-32-le"), "<u4")
        ends = np.cumsum(lens + 1, dtype=np.int32) - 1  # the node after a word's last character
        first = ends - lens
        letters = np.zeros(len(flat) + self.longest, np.int32)
        letters[: len(flat)] = self.letter[flat]
        letters[ends] = 0
        inside = np.ones(len(flat), bool)
        inside[ends] = False
        at = np.flatnonzero(inside).astype(np.int32)
        key, start, length, piece, score = self._arcs_of_all(letters, at, at - np.repeat(first, lens))
        best, second, back = np.full(len(flat), -np.inf), np.full(len(flat), -np.inf), np.zeros(len(flat), np.int32)
        best[first] = 0.0
        cuts = [*np.flatnonzero(np.diff(key, prepend=-1)).tolist(), len(key)]
        for a, b in zip(cuts, cuts[1:]):  # no two arcs of a run end at the same node
            s = start[a:b]
            e = s + length[a]
            c1, c2, o1 = best[s] + score[a:b], second[s] + score[a:b], best[e]
            second[e] = np.maximum(np.minimum(o1, c1), np.maximum(second[e], c2))
            better = np.flatnonzero(c1 > o1)
            best[e[better]] = c1[better]
            back[e[better]] = a + better
        on, live, low = np.zeros(len(flat), bool), ends, first
        while len(live):
            on[live] = True
            live = live - length[back[live]]
            more = live > low
            live, low = live[more], low[more]
        nodes = np.flatnonzero(on)
        word, ids = np.searchsorted(ends, nodes), piece[back[nodes]]
        bare = np.flatnonzero(ids < 0)
        if len(bare):
            chars = [chr(c).encode() for c in flat[nodes[bare] - 1].tolist()]
            times = np.ones(len(ids), np.int64)
            times[bare] = list(map(len, chars))
            place = np.cumsum(times) - times
            ids, word = np.repeat(ids, times), np.repeat(word, times)
            for k, c in zip(place[bare].tolist(), chars):
                ids[k : k + len(c)] = [self.byte_ids[b] for b in c]
        raw = ids.astype("<u4").tobytes()
        to = np.cumsum(np.bincount(word, minlength=len(words)) * 4).tolist()
        return [raw[s:e] for s, e in zip([0, *to], to)], best[ends], best[ends] - second[ends]

    def arcs(self, word: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """Arcs that end at each position: (start, score, ids)."""
        ends: list[list] = [[] for _ in range(len(word) + 1)]
        get = self.pieces.get
        for i in range(len(word)):
            for j in range(i + 1, min(len(word), i + self.longest) + 1):
                if hit := get(word[i:j]):
                    ends[j].append((i, hit[1], (hit[0],)))
            if word[i] not in self.pieces:
                ends[i + 1].append((i, self.unknown, tuple(self.byte_ids[b] for b in word[i].encode())))
        return ends

    def n_best(self, word: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best (score, ids) of a word, best first."""
        ends = self.arcs(word)
        ahead = [0.0] + [0.0] * len(word)
        for j in range(1, len(word) + 1):
            ahead[j] = max(ahead[i] + s for i, s, _ in ends[j])
        # backward: (minus the best total through here, position, number, score so far, step); of equal totals the one
        # nearest to its end goes first, as a run of one character has very many segmentations of equal score. A step
        # is (the step after it, ids), so that partial segmentations share their tails
        heap: list[tuple] = [(-ahead[-1], len(word), 0, 0.0, None)]
        found: list[tuple[float, tuple[int, ...]]] = []
        made = 0
        while heap and len(found) < n:
            _, at, _, score, step = heapq.heappop(heap)
            if at == 0:
                ids: list[int] = []
                while step:
                    ids += step[1]
                    step = step[0]
                found.append((score, tuple(ids)))
                continue
            for i, s, piece in ends[at]:
                made += 1
                heapq.heappush(heap, (-(score + s + ahead[i]), i, made, score + s, (step, piece)))
        return found

    def words(self, text: str) -> list[str]:
        """Words with the blanks before them, all but the first blank; the first one of a text is added by the model."""
        if not text:
            return []
        parts = text.replace(BLANK, " ").split(" ")
        if "" not in parts:
            return parts
        out, blanks = [], ""
        for w in parts:
            if w:
                out.append(blanks + w)
                blanks = ""
            else:
                blanks += BLANK
        # what is left at the end is a word of blanks alone, one of them implied
        return out + ([blanks[1:]] if blanks else [])

    def _learn(self, words: set[str]) -> None:
        new = list(words - self.memo.keys())
        if not new:
            return
        if len(self.memo) + len(new) > MEMO:  # the words met first are the frequent ones: they stay
            for w in [w for w, k in self.memo.items() if k >= MEMO // 3]:
                del self.memo[w]
            size = len(self.memo)
            del self.raw[size:], self.plain[size:]
            self.score, self.loss = self.score[:size], self.loss[:size]
            new = list(words - self.memo.keys())
        short, long = [w for w in new if len(w) < VECTOR], [w for w in new if len(w) >= VECTOR]
        raws, scores, losses = [], [self.score], [self.loss]
        run, size = [], 0
        for w in chain(short, [None]):
            if w is None or size > CHUNK:
                if run:
                    got = self._solve(run)
                    for x, y in zip((raws, scores, losses), got):
                        x.append(y)
                run, size = [], 0
            if w is not None:
                run.append(BLANK + w)
                size += len(w) + 2
        for w in long:
            best = self.n_best(BLANK + w, 2)
            raws.append([array("I", best[0][1]).tobytes()])
            scores.append(np.array([best[0][0]]))
            losses.append(np.array([best[0][0] - best[1][0] if len(best) > 1 else np.inf]))
        texts = self.texts
        for w, raw in zip(short + long, chain.from_iterable(raws), strict=True):
            self.memo[w] = len(self.raw)
            self.raw.append(raw)
            self.plain.append(b"".join([texts[i] for i in memoryview(raw).cast("I")]))
        self.score, self.loss = np.concatenate(scores), np.concatenate(losses)

    def ranked(self, word: str, n: int) -> list[tuple[float, bytes]]:
        """The n best (score, ids as bytes) of a word that was learned, its best first."""
        if (word, n) not in self.deep:
            if len(self.deep) > MEMO // 10:
                self.deep.clear()
            k = self.memo[word]
            found = [(s, array("I", ids).tobytes()) for s, ids in self.n_best(BLANK + word, n + 1)]
            self.deep[word, n] = [(float(self.score[k]), self.raw[k]), *[x for x in found if x[1] != self.raw[k]][: n - 1]]
        return self.deep[word, n]

    def encode_all(self, texts: Iterable[str], n: int = N_BEST) -> Iterator[tuple[bytes, list[float], list[tuple[tuple[int, int], ...]], bytes]]:
        """Of every text the ids of the best segmentation (unsigned 32-bit), of the n best the scores and the (word, rank) that differ, and the text decoded."""
        cut = [self.words(t) for t in texts]
        self._learn(set().union(*cut))
        number = np.fromiter(map(self.memo.__getitem__, chain.from_iterable(cut)), np.int64, sum(map(len, cut)))
        score, loss = self.score[number], self.loss[number]
        at = 0
        for words in cut:
            here = slice(at, at + len(words))
            at += len(words)
            numbers = number[here].tolist()
            ids, plain = b"".join([self.raw[k] for k in numbers]), b"".join([self.plain[k] for k in numbers])[1:]
            total = float(score[here].sum())
            near = np.argsort(loss[here], kind="stable")[: n - 1]
            near = near[loss[here][near] < np.inf].tolist()
            yield ids, *self._combine(total, [(k, self.ranked(words[k], n)) for k in near], n), plain

    @staticmethod
    def _combine(total: float, near: list[tuple[int, list[tuple[float, bytes]]]], n: int) -> tuple[list[float], list[tuple[tuple[int, int], ...]]]:
        """Rank vectors over the few words that may differ, by total loss."""
        none = (0,) * len(near)
        heap, seen, scores, picks = [(0.0, none)], {none}, [], []
        while heap and len(scores) < n:
            loss, ranks = heapq.heappop(heap)
            scores.append(total - loss)
            picks.append(tuple((k, r) for (k, _), r in zip(near, ranks) if r))
            for z, (_, ways) in enumerate(near):
                more = ranks[:z] + (ranks[z] + 1,) + ranks[z + 1 :]
                if more[z] < len(ways) and more not in seen:
                    seen.add(more)
                    heapq.heappush(heap, (sum(w[0][0] - w[r][0] for (_, w), r in zip(near, more)), more))
        return scores, picks

    def encode(self, text: str, n: int = N_BEST) -> tuple[bytes, list[float], list[tuple[tuple[int, int], ...]]]:
        return next(self.encode_all([text], n))[:3]

    def ids(self, text: str, pick: tuple[tuple[int, int], ...], n: int = N_BEST) -> list[int]:
        """Ids of one of the segmentations that ``encode`` named."""
        words, other = self.words(text), dict(pick)
        self._learn(set(words))
        raw = b"".join([self.ranked(w, n)[other[k]][1] if k in other else self.raw[self.memo[w]] for k, w in enumerate(words)])
        return np.frombuffer(raw, "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.texts.__getitem__, ids)).decode(errors="replace")[1:]


@cache
def lattice(path: str) -> Lattice:
    return Lattice(path)


def encode(docs: DataFrame, path: str, n: int = N_BEST) -> DataFrame:
    """doc_id, ids (best segmentation), scores of the n best, and their ids from the second on."""

    def run(it):
        m = lattice(path)
        for batch in it:
            for first, texts in batches(batch.column("text").to_pylist(), BATCH):
                ids, scores, more = [], [], []
                for t, (best, s, picks, _) in zip(texts, list(m.encode_all(texts, n))):
                    ids.append(np.frombuffer(best, "<u4").tolist()), scores.append(s), more.append([m.ids(t, p, n) for p in picks[1:]])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(texts)), pa.array(ids, pa.list_(pa.int32())), pa.array(scores, pa.list_(pa.float64())), pa.array(more, pa.list_(pa.list_(pa.int32())))], ["doc_id", "ids", "scores", "others"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, ids array<int>, scores array<double>, others array<array<int>>")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows (doc_id, ids)."""

    def run(it):
        m = lattice(path)
        for batch in it:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([m.decode(x or []) for x in batch.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return map_arrow(rows.select("doc_id", "ids"), run, "doc_id long, text string")


def digest(docs: DataFrame, path: str, n: int = N_BEST) -> DataFrame:
    """Per document the number and crc32 of the best ids, the n best scores, and whether decoding gives the text back."""

    def run(it):
        m = lattice(path)
        for batch in it:
            for first, texts in batches(batch.column("text").to_pylist(), BATCH):
                rows = []
                for t, (best, scores, _, plain) in zip(texts, m.encode_all(texts, n)):
                    rows.append((len(best) // 4, zlib.crc32(best), scores, plain == t.encode()))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(texts)), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.float64())), pa.array(cols[3], pa.bool_())], ["doc_id", "n_pieces", "ids_crc32", "scores", "exact"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_pieces long, ids_crc32 long, scores array<double>, exact boolean")
