"""SentencePiece encoding and decoding by a streaming Viterbi search.

A text is a stream of normalised characters. The search keeps, for each
boundary since the last commit, the piece that the best path to it ends with.
When the paths of all boundaries that later pieces can still start from meet
in one boundary, the ids up to there are final and leave the window, which is
so bounded by the longest piece and not by the text.

No piece reaches over the start of a run of spaces, so in prose all paths meet
at every word and the window is committed there. Byte-pair windows of many
words are searched in lockstep, a character of each at a time; what a worker
has committed for a word is remembered, as it depends on nothing before it.
Longer stretches, and models with pieces that reach over spaces, go through
one window that slides.

Unigram models take the path of the highest total score. In a byte-pair model
a path is right if each two neighbours on it stay apart when they are merged
alone, which holds for exactly one path, so the same search finds what the
merges give."""

from __future__ import annotations

import itertools
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import table

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Words of each of two generations that a worker remembers, and the longest that is searched in lockstep.
MEMO, WORD_CHARS = 80_000, 48
#: Words that are looked up together, and rows that a worker handles at a time.
GROUP, SLICE = 200_000, 384
#: Pairs of pieces that a worker remembers: as a power of two in lockstep, and for sliding windows.
PAIR_BITS, PAIRS = 21, 100_000
#: Characters that are normalised at a time, if a space between letters follows.
PART_CHARS = 1 << 16
BETWEEN = re.compile(r"(?<=[^\W_]) (?=[^\W_])")
WORD, LINE_WORD, RUN = re.compile(f"{SPACE}+[^{SPACE}]*"), re.compile(f"(?:{SPACE}+|\n)[^{SPACE}\n]*"), SPACE * 2
#: What the left edge of a stream ends with; characters that no piece holds have smaller numbers.
START, DEAD = -1, np.iinfo(np.int64).min
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[at : at + size]
            at += size


def model_kind(proto: bytes) -> int:
    trainer = next((v for k, v in _fields(proto) if k == 2), b"")
    return next((v for k, v in _fields(trainer) if k == 3), UNIGRAM)


class Lookup:
    """A fixed map of 64-bit keys to numbers for many keys at a time; -1 for others."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        left, at = np.arange(len(keys)), slot(keys, self.bits)
        while left.size:
            at %= self.keys.size
            free = self.keys[at] < 0
            _, first = np.unique(at, return_index=True)
            put = np.zeros(left.size, bool)
            put[first] = True
            put &= free
            self.keys[at[put]], self.values[at[put]] = keys[left[put]], values[left[put]]
            left, at = left[~put], at[~put] + 1

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = slot(keys, self.bits)
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], -1)
        left = np.flatnonzero((held != keys) & (held >= 0))
        at = at[left]
        while left.size:
            at = (at + 1) % self.keys.size
            held = self.keys[at]
            same = held == keys[left]
            out[left[same]] = self.values[at[same]]
            more = ~same & (held >= 0)
            left, at = left[more], at[more]
        return out


def slot(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


class Codec:
    def __init__(self, proto: bytes) -> None:
        import sentencepiece

        r = self.reader = sentencepiece.SentencePieceProcessor(model_proto=proto)
        kind = model_kind(proto)
        if kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and byte-pair models are read")
        pieces = [r.id_to_piece(i) for i in range(r.get_piece_size())]
        special = {i for i in range(len(pieces)) if r.is_control(i) or r.is_unknown(i) or r.is_byte(i)}
        self.bytes = {int(pieces[i][1:-1], 16): i for i in range(len(pieces)) if r.is_byte(i)}
        self.unknown = r.unk_id()
        self._prepare(kind, pieces, [r.get_score(i) for i in range(len(pieces))], {p: i for i, p in enumerate(pieces) if i not in special and not r.is_unused(i)})
        # UTF-8 of each id's text, spaces as such; of a byte piece the byte.
        self.utf8 = [b"" if i in special else p.replace(SPACE, " ").encode("utf-8", "surrogatepass") for i, p in enumerate(pieces)]
        for byte, i in self.bytes.items():
            self.utf8[i] = bytes([byte])
        self.utf8[self.unknown] = " ⁇ ".encode()
        self.dummy = r.normalize("a").startswith(SPACE)
        #: Can a text be normalised in parts that are cut at a space between letters?
        self.cuts = r.normalize("a b") == r.normalize("a") + r.normalize("b")

    def _prepare(self, kind: int, pieces: list[str], scores: list[float], ids: dict[str, int]) -> None:
        """What the search needs: texts, lengths and scores by id, and the automaton that finds all pieces that end at a character."""
        self.bpe, self.ids, self.vocabulary = kind == BPE, dict(ids), len(pieces)
        self.text, self.score = list(pieces), list(scores)
        self.longest = max(map(len, ids), default=1)
        # Characters that are in pieces but no piece themselves get ids past the vocabulary.
        worst = min((scores[i] for i in ids.values()), default=0.0)
        for c in sorted(set("".join(ids)) - ids.keys()):
            self.ids[c] = len(self.text)
            self.text.append(c)
            self.score.append(worst - 10)
        self.size = [len(x) for x in self.text]
        self.pieces = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for text, i in self.ids.items():
            self.pieces.add_word(text, i)
        self.pieces.make_automaton()
        #: Do all paths meet at a line end, and at the start of each run of spaces?
        self.lines = "\n" not in self.ids
        self.meets = not any(SPACE in p.lstrip(SPACE) for p in ids)
        self.known: dict[int, bool] = {}
        self.splits: dict[int, tuple[int, int, bool]] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        #: Commits, and the most boundaries that a window has held.
        self.commits = self.widest = 0
        if self.bpe:
            self._prepare_pairs()

    def _prepare_pairs(self) -> None:
        """Tables for searching many words at a time: a trie of the pieces, and which two pieces make a third."""
        n = len(self.text)
        self.codes = np.zeros(max(map(ord, "".join(self.ids)), default=0) + 2, np.int64)
        alphabet = sorted(set("".join(self.ids)))
        self.codes[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        self.step = len(alphabet) + 1
        nodes: dict[str, int] = {"": 0}
        for text in self.ids:
            for k in range(1, len(text) + 1):
                nodes.setdefault(text[:k], len(nodes))
        inner = [(nodes[x[:-1]] * self.step + int(self.codes[ord(x[-1])]), i) for x, i in nodes.items() if x]
        self.trie = Lookup(*np.array(inner or [(0, -1)], np.int64).T)
        self.piece_at = np.array([self.ids.get(x, -1) for x in nodes], np.int32)
        joins = [(self.ids[x[:k]] * n + self.ids[x[k:]], i) for x, i in self.ids.items() for k in range(1, len(x)) if x[:k] in self.ids and x[k:] in self.ids]
        self.join = Lookup(*np.array(joins or [(0, -1)], np.int64).T)
        self.scores, self.sizes = np.array(self.score), np.array(self.size, np.int64)
        # _split of the pieces met so far; whole is -1 for others.
        self.first, self.second = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.whole = np.full(n, -1, np.int8)
        self.pairs = np.full(1 << PAIR_BITS, -1, np.int64)


    def merged(self, text: str, least: int = 1) -> list[str]:
        """Byte-pair merges of a short text, best score first, then leftmost, until `least` parts are left."""
        parts = list(text)
        while len(parts) > least:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _split(self, piece: int) -> tuple[int, int, bool]:
        """What the last merge into a piece joins, -1 for a character; do its characters merge into it?"""
        if (found := self.splits.get(piece)) is None:
            parts = self.merged(self.text[piece], 2)
            found = (self.ids[parts[0]], self.ids[parts[1]], True) if len(parts) == 2 else (-1, -1, len(self.text[piece]) == 1)
            self.splits[piece] = found
        return found

    def _work_out(self, pieces: np.ndarray) -> None:
        for i in np.unique(pieces[self.whole[pieces] < 0]).tolist():
            self.first[i], self.second[i], self.whole[i] = self._split(i)

    def _apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Do two pieces stay apart? Merges are undone, last first, on the side
        that was finished later; what then faces each other at the seam may not
        have a merge of its own that comes before the one undone. Of equal
        scores the leftmost merge comes first."""
        n, out, at = len(self.text), np.zeros(left.size, bool), np.arange(left.size)
        # A merge over the seam comes first if it scores over `least`, or equals it where the seam lies left of the merge undone.
        least, equal = np.full(left.size, -np.inf), np.ones(left.size, bool)
        while at.size:
            over = self.join(left * n + right)
            score = np.where(over >= 0, self.scores[over], -np.inf)
            before = (over >= 0) & ((score > least) | (equal & (score == least)))
            self._work_out(left)
            self._work_out(right)
            a, b = self.second[left], self.first[right]
            done = (a < 0) & (b < 0)
            out[at[done & ~before]] = True
            on = ~(done | before)
            at, left, right, a, b = at[on], left[on], right[on], a[on], b[on]
            undo = (b < 0) | ((a >= 0) & (self.scores[left] < self.scores[right]))
            least, equal = np.where(undo, self.scores[left], self.scores[right]), ~undo
            left, right = np.where(undo, a, left), np.where(undo, right, b)
        return out

    def _follow(self, left: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Can pieces follow others, or START, in a byte-pair path? Pairs are remembered, a later one takes the place of an earlier."""
        out = np.empty(left.size, bool)
        alone = left < 0
        if alone.any():
            self._work_out(piece[alone])
            out[alone] = self.whole[piece[alone]] > 0
            rest = np.flatnonzero(~alone)
            left, piece = left[rest], piece[rest]
        else:
            rest = slice(None)
        keys = left * len(self.text) + piece
        at = slot(keys, PAIR_BITS)
        held = self.pairs[at]
        new = np.flatnonzero(held >> 1 != keys)
        if new.size:
            each, where, back = np.unique(keys[new], return_index=True, return_inverse=True)
            x, y = left[new[where]], piece[new[where]]
            self._work_out(y)
            ok = (self.whole[y] > 0) & self._apart(x, y)
            held[new] = (each << 1 | ok)[back]
            self.pairs[at[new]] = held[new]
        out[rest] = held & 1 > 0
        return out

    def _follows(self, left: int, piece: int) -> bool:
        """_follow for one pair of a sliding window, without the cost of arrays."""
        if not self._split(piece)[2]:
            return False
        if left < 0:
            return True
        ids, score, text = self.ids.get, self.score, self.text
        least, equal = float("-inf"), True
        while True:
            over = ids(text[left] + text[piece])
            if over is not None and (score[over] > least or (equal and score[over] == least)):
                return False
            a, b = self._split(left)[1], self._split(piece)[0]
            if a < 0 and b < 0:
                return True
            if b < 0 or (a >= 0 and score[left] < score[piece]):
                least, equal, left = score[left], False, a
            else:
                least, equal, piece = score[piece], True, b

    def lockstep(self, words: list[str]) -> list[bytes]:
        """The final ids of words that aren't empty, each between two boundaries
        where all paths meet: step by step, the next boundary of all words.

        Cells are characters, by position and then by word, the longest words
        first, so that the words that have a position are the first of its row."""
        if not words:
            return []
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(lengths) - lengths
        rank = np.empty(len(words), np.int64)
        rank[np.argsort(-lengths, kind="stable")] = np.arange(len(words))
        high = int(lengths.max())
        wide = len(words) - np.cumsum(np.bincount(lengths, minlength=high + 1))  # words that have a position
        first = np.concatenate([[0], np.cumsum(wide)])
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        lane = np.repeat(rank, lengths)
        cell = first[np.arange(chars.size) - np.repeat(starts, lengths)] + lane
        codes = np.empty(chars.size, np.int64)
        codes[cell] = self.codes[np.minimum(chars, self.codes.size - 1)]
        # By cell: the piece that the path to the boundary after it ends with.
        last = np.full(chars.size, DEAD, np.int64)
        strange = np.flatnonzero(codes[cell] == 0)
        last[cell[strange]] = START - 1 - chars[strange]
        # All pieces that end at a boundary: the longest one of each, then the others.
        found = []
        at = np.flatnonzero(codes > 0)
        node = self.trie(codes[at]).astype(np.int64)
        row = np.repeat(np.arange(high), wide[:high])[at]
        lane = at - first[row]
        seen = np.zeros(chars.size, bool)
        for length in range(1, self.longest + 1):
            piece = self.piece_at[node]
            held = np.flatnonzero(piece >= 0)
            found.append((first[row[held] + length - 1] + lane[held], row[held], lane[held], piece[held]))
            to = row + length
            on = np.flatnonzero(lane < wide[np.minimum(to, high)])
            code = codes[first[to[on]] + lane[on]]
            step = self.trie(node[on] * self.step + code)
            go = np.flatnonzero((step >= 0) & (code > 0))
            if not go.size:
                break
            node = step[go].astype(np.int64)
            row, lane = row[on[go]], lane[on[go]]
        tops, others = [], []
        for to, row, lane, piece in reversed(found):
            again = seen[to]
            seen[to] = True
            left = np.where(row > 0, first[row - 1] + lane, -1)
            for group, some in ((tops, np.flatnonzero(~again)), (others, np.flatnonzero(again))):
                group.append((to[some], left[some], piece[some]))
        groups = []
        for group in (tops, others):
            to, left, piece = (np.concatenate(x) for x in zip(*group, strict=True))
            order = np.argsort(to, kind="stable")
            groups.append((to[order], left[order], piece[order].astype(np.int64)))
        bounds = [np.searchsorted(to, first).tolist() for to, *_ in groups]
        for end in range(high):
            for (to, left, piece), rows in zip(groups, bounds, strict=True):
                part = slice(rows[end], rows[end + 1])
                if part.start == part.stop:
                    continue
                to, left, piece = to[part], left[part], piece[part]
                before = np.where(left >= 0, last[left], START)
                ask = np.flatnonzero((last[to] == DEAD) & (before != DEAD))
                ok = ask[self._follow(np.maximum(before[ask], START), piece[ask])]
                last[to[ok]] = piece[ok]
        # Paths from the ends; a piece is put where it starts.
        path = np.full(chars.size, DEAD, np.int64)
        lane, at = rank, lengths
        while lane.size:
            piece = last[first[at - 1] + lane]
            at = at - np.where(piece >= 0, self.sizes[piece], 1)
            path[first[at] + lane] = piece
            on = np.flatnonzero(at)
            lane, at = lane[on], at[on]
        path = path[cell]
        held = path != DEAD
        ids, counts = path[held], np.add.reduceat(held, starts, dtype=np.int64)
        self.commits += len(words)
        self.widest = max(self.widest, high + 1)
        ends = np.cumsum(counts)
        data, a, b = ids.astype(np.int32).tobytes(), (4 * (ends - counts)).tolist(), (4 * ends).tolist()
        out = [data[i:j] for i, j in zip(a, b, strict=True)]
        other = np.add.reduceat((ids < 0) | (ids >= self.vocabulary), ends - counts)
        for k in np.flatnonzero(other).tolist():
            out[k] = array("i", self._final(ids[a[k] // 4 : b[k] // 4].tolist())).tobytes()
        return out

    def search(self, stream: Iterable[str]) -> Iterator[list[int]]:
        """The final ids of a stream of characters, given in parts, commit by commit.

        last[k] is the piece that the best path to boundary k of the window ends
        with: None where no path leads, START at its left edge when nothing is
        before it, less for a character that no piece holds, where all paths meet."""
        size, score, matcher, bpe, reach, known = self.size, self.score, self.pieces, self.bpe, self.longest, self.known
        last: list[int | None] = [START]
        total = [0.0]
        base = read = 0  # of the stream: the window's left edge, characters of the parts before
        found = matcher.iter("")
        full = check = 4 * reach

        def fill(part: str, end: int) -> None:
            """Boundaries before `end` (of the window) that no piece ends at."""
            while len(last) < end:
                c = part[base + len(last) - 1 - read]
                known = c in self.ids
                total.append(0.0 if known or total[-1] is None else total[-1])
                last.append(None if known else START - 1 - ord(c))

        def path(end: int) -> list[int]:
            ids = []
            while end > 0:
                ids.append(p := last[end])
                end -= size[p] if p >= 0 else 1
            return ids[::-1]

        def meeting() -> int:
            """The boundary in which the paths of all that later pieces can start from meet."""
            paths = {k for k in range(max(0, len(last) - reach), len(last)) if k == 0 or last[k] is not None}
            while len(paths) > 1:
                paths.remove(top := max(paths))
                paths.add(top - (size[last[top]] if last[top] >= 0 else 1))
            return paths.pop()

        def commit() -> list[int]:
            """The ids up to where all paths meet leave the window."""
            nonlocal last, total, base, check
            meet = meeting()
            if not meet:
                check = len(last) + reach
                return []
            self.commits += 1
            self.widest = max(self.widest, len(last))
            ids, gone = path(meet), total[meet]
            last, total = last[meet:], [x - gone for x in total[meet:]]
            base, check = base + meet, full
            return self._final(ids)

        for part in stream:
            found.set(part, False)
            for end, piece in found:
                at = end - base + 1
                if at < len(last) and bpe:
                    continue
                if at >= check <= len(last):
                    yield commit()
                    at = end - base + 1
                if at > len(last):
                    fill(part, at)
                if (j := at - size[piece]) < 0 or (left := last[j]) is None:
                    continue
                if bpe:
                    left = max(left, START)
                    if (ok := known.get(left << 32 | piece)) is None:
                        if len(known) >= PAIRS:
                            known.clear()
                        ok = known[left << 32 | piece] = self._follows(left, piece)
                    if ok:
                        last.append(piece)
                        total.append(0.0)
                    continue
                high = total[j] + score[piece]
                if at == len(last):
                    last.append(piece)
                    total.append(high)
                elif last[at] is None or high > total[at]:
                    last[at], total[at] = piece, high
            fill(part, read + len(part) - base + 1)
            read += len(part)
            while len(last) >= check:  # a part may end in characters that no piece holds
                yield commit()
        self.commits += 1
        self.widest = max(self.widest, len(last))
        yield self._final(path(len(last) - 1))

    def _final(self, ids: list[int]) -> list[int]:
        """Ids of the model: characters that are no piece become bytes, or the unknown id."""
        if not ids or (min(ids) >= 0 and max(ids) < self.vocabulary):
            return ids
        out: list[int] = []
        for i in ids:
            if 0 <= i < self.vocabulary:
                out.append(i)
            elif self.bytes:
                out += (self.bytes[b] for b in (self.text[i] if i >= 0 else chr(START - 1 - i)).encode("utf-8", "surrogatepass"))
            else:
                out.append(self.unknown)
        return out

    def _learn(self, words: set[str]) -> None:
        """Search the words that neither generation has; a space stands before each."""
        before = words & self.old.keys()
        self.young.update(zip(before, map(self.old.__getitem__, before), strict=True))
        new = words - before
        short = [x for x in new if len(x) < WORD_CHARS] if self.bpe else []
        self.young.update(zip(short, self.lockstep([x if x[:1] == "\n" and self.lines else SPACE + x for x in short]), strict=True))
        for x in new.difference(short):
            stretch = x if x[:1] == "\n" and self.lines else SPACE + x
            self.young[x] = b"".join(array("i", ids).tobytes() for ids in self.search((stretch,)))

    def _normalized(self, text: str) -> Iterator[str]:
        at = 0
        while self.cuts and (cut := BETWEEN.search(text, at + PART_CHARS)):
            yield self.reader.normalize(text[at : cut.start()])
            at = cut.end()
        yield self.reader.normalize(text[at:] if at else text)

    def _words(self, part: str) -> list[str]:
        """What stands from one boundary where all paths meet to the next, without the space before it; what starts with a line end has none."""
        marked = part.replace("\n", f"{SPACE}\n") if self.lines else part
        if RUN in marked:
            return [x.removeprefix(SPACE) for x in (LINE_WORD if self.lines else WORD).findall(part)]
        return marked[1:].split(SPACE) if part else []

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts as 32-bit integers; none for a null or empty one."""
        out = [bytearray() for _ in texts]
        held: list[tuple[int, list[bytes | None], dict[int, str]]] = []
        size = 0

        def clear() -> None:
            nonlocal size
            self._learn({x for *_, missed in held for x in missed.values()})
            for k, found, missed in held:
                for i, x in missed.items():
                    found[i] = self.young[x]
                out[k] += b"".join(found)
            held.clear()
            size = 0
            if len(self.young) > MEMO:
                self.old, self.young = self.young, {}

        for k, text in enumerate(texts):
            parts = self._normalized(text) if text else iter(())
            if not (self.meets and self.dummy):
                for ids in self.search(parts):
                    out[k] += array("i", ids).tobytes()
                continue
            for part in parts:
                words = self._words(part)
                found = [*map(self.young.get, words)]
                held.append((k, found, {i: words[i] for i, x in enumerate(found) if x is None}))
                size += len(words)
                if size >= GROUP:
                    clear()
        clear()
        return [bytes(x) if self.bytes else self._runs(x) for x in out]

    def _runs(self, data: bytes) -> bytes:
        """Without byte pieces, a run of unknown characters is one id."""
        ids = np.frombuffer(data, np.int32)
        again = np.append(False, (ids[1:] == self.unknown) & (ids[:-1] == self.unknown))[: ids.size]
        return ids[~again].tobytes()

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_all([text])[0], np.int32).tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ids; runs of byte pieces are UTF-8, the space that starts every encoded text is dropped."""
        return b"".join(map(self.utf8.__getitem__, ids)).decode("utf-8", "replace").removeprefix(" ")


def load(path: str = MODEL_PATH) -> bytes:
    """The model file as bytes: the driver reads it once, executors get it by broadcast."""
    with open(path, "rb") as file:
        return file.read()


@lru_cache(maxsize=1)
def _codec(proto: bytes) -> Codec:
    """One codec a worker process, so that its memory of words serves all its tasks."""
    return Codec(proto)


def encode(docs: DataFrame, model: str = MODEL_PATH, text: str = "text", out: str = "ids", decoded: str | None = None) -> DataFrame:
    """docs with the ids of the text in out, and in decoded, if named, the text that they decode to.
    A null text has no ids and decodes to an empty text; columns of these names are replaced.

    Arrow batches are worked off in slices, so a worker holds few rows as Python objects."""
    shared = docs.sparkSession.sparkContext.broadcast(load(model))
    # The text under a name of its own, so that it can be replaced as well.
    docs = docs.withColumn("_sp_text", F.col(text)).drop(*(c for c in (out, decoded) if c))
    fields = [*docs.drop("_sp_text").schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))]
    schema = T.StructType(fields + ([T.StructField(decoded, T.StringType())] if decoded else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for batch in batches:
            at_text = batch.schema.get_field_index("_sp_text")
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                ids = codec.encode_all(part.column(at_text).to_pylist())
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                every = np.frombuffer(b"".join(ids), np.int32)
                columns = [c for i, c in enumerate(part.columns) if i != at_text]
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(every)))
                if decoded:
                    columns.append(pa.array([codec.decode(every[a:b].tolist()) for a, b in itertools.pairwise(ends)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, model: str = MODEL_PATH, ids: str = "ids", out: str = "text") -> DataFrame:
    """rows with the text of the ids in out; null ids give a null text."""
    shared = rows.sparkSession.sparkContext.broadcast(load(model))

    def of(each: pd.Series) -> pd.Series:
        codec = _codec(shared.value)
        return pd.Series([None if x is None else codec.decode([int(i) for i in x]) for x in each], dtype="object")

    return rows.withColumn(out, F.pandas_udf(of, "string")(F.col(ids)))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as ids, and whether they decode to the text again."""
    found = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), decoded="back")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", F.sha2(F.col("back").cast("binary"), 256).alias("decoded_sha256"), (F.col("back") == F.coalesce("text", F.lit(""))).alias("round_trip"))
