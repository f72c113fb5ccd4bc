"""Token counts of byte-level BPE by compiled finite-state transducers.

Two deterministic machines take the place of the tokenizer library.

* The **boundary machine** reads one symbol per character and says before which characters a new word starts. Its
  transition monoid, the set of all maps from start state to end state that any run of symbols can cause, is
  finite and small, so a chunk of characters is one element of it. Chunks are read side by side, their elements
  are composed by a parallel prefix scan, and every chunk then knows the state it starts in.
* The **token machine** reads the bytes of a word. Every transition carries the change of the number of tokens of
  what has been read so far, so a word has as many tokens as its transitions say in sum. A state is what the rest
  of the word can still see: for every suffix that may grow into a token, the last token before it and the token
  count there. Which token ends a prefix is decided by whether two adjacent tokens survive merging. States are
  made when they are first met and kept by the Python worker; a table over its bound is dropped between blocks.

Both run in NumPy over all chunks or words of a block at once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import chunks_by_size

BLOCK_CHARS = 131_072  # characters read at once; a longer text is read in pieces of about this size
CHUNK = 64  # characters of a chunk of the boundary machine
MAX_STATES = 120_000  # states kept between blocks; a block adds at most one per byte
MAX_PAIRS = 500_000  # pairs of tokens remembered
_CUT = regex.compile(r"(?<=\p{L})(?=[\x00-\x40])")  # places where a long text may be cut

# Symbols of the boundary machine. White space and apostrophes are told apart by what follows them.
LETTER, NUMBER, OTHER, SPACE_RUN, SPACE_LAST, BLANK_LAST, CLITIC2, CLITIC3, BREAK, PAD = range(10)
# States: after a forced end, in letters, in numbers, in others, in white space, after a blank that joins what
# follows, with one or two characters of a clitic to come.
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_SPACE, AFTER_BLANK, CLITIC_LAST, CLITIC_MORE = range(8)


def _boundary_step(state: int, symbol: int) -> tuple[int, bool]:
    """Next state, and whether a word starts at this character."""
    if symbol == PAD:
        return state, False
    if symbol == BREAK:
        return START, False
    if state == CLITIC_MORE:
        return CLITIC_LAST, False
    if state == CLITIC_LAST:
        return START, False
    if symbol in (LETTER, NUMBER, OTHER):
        own = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS}[symbol]
        return own, state not in (own, AFTER_BLANK)
    if symbol in (CLITIC2, CLITIC3):
        if state in (IN_OTHERS, AFTER_BLANK):
            return IN_OTHERS, False
        return (CLITIC_LAST if symbol == CLITIC2 else CLITIC_MORE), True
    if symbol == SPACE_RUN:
        return IN_SPACE, state != IN_SPACE
    return (AFTER_BLANK if symbol == BLANK_LAST else START), True


@lru_cache(maxsize=1)
def _boundary_machine() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tables: next state and start flag by (state, symbol); monoid element by symbol, products of elements, maps of elements."""
    steps = [[_boundary_step(s, c) for c in range(10)] for s in range(8)]
    nxt = np.array([[t for t, _ in row] for row in steps], dtype=np.int8)
    flag = np.array([[f for _, f in row] for row in steps], dtype=bool)
    identity = tuple(range(8))
    index, found = {identity: 0}, [identity]
    for element in found:  # grows while it is read
        for c in range(10):
            made = tuple(int(nxt[s, c]) for s in element)
            if made not in index:
                index[made] = len(found)
                found.append(made)
    by_symbol = np.array([index[tuple(int(x) for x in nxt[:, c])] for c in range(10)], dtype=np.int32)
    product = np.array([[index[tuple(b[s] for s in a)] for b in found] for a in found], dtype=np.int32)
    return nxt, flag, by_symbol, product, np.array(found, dtype=np.int8)


@lru_cache(maxsize=1)
def _character_classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or SPACE_RUN of every code point."""
    classes = np.full(0x110000, OTHER, dtype=np.uint8)
    for lo in range(0, 0x110000, 0x8000):
        if lo == 0xD800 - 0xD800 % 0x8000:
            points = [p for p in range(lo, lo + 0x8000) if not 0xD800 <= p < 0xE000]
        else:
            points = list(range(lo, lo + 0x8000))
        text = "".join(map(chr, points))
        places = np.array(points)
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE_RUN, r"\s+")):
            for run in regex.finditer(pattern, text):
                classes[places[run.start() : run.end()]] = kind
    return classes


def _symbols(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Symbol of every character; ``ends`` marks the places of BREAK."""
    symbols = _character_classes()[points]
    symbols[ends] = BREAK
    following = np.append(symbols[1:], np.uint8(BREAK))
    last = (symbols == SPACE_RUN) & (following != SPACE_RUN) & (following != BREAK)
    symbols[last] = np.where(points[last] == 0x20, BLANK_LAST, SPACE_LAST)
    quotes = np.flatnonzero((points == 0x27) & (symbols == OTHER))
    if len(quotes):
        padded = np.append(points, [0, 0])
        padded[np.flatnonzero(ends)] = 0
        one, two = padded[quotes + 1], padded[quotes + 2]
        symbols[quotes[np.isin(one, [ord(c) for c in "stmd"])]] = CLITIC2
        pairs = np.zeros(len(quotes), dtype=bool)
        for a, b in ("re", "ve", "ll"):
            pairs |= (one == ord(a)) & (two == ord(b))
        symbols[quotes[pairs]] = CLITIC3
    return symbols


def _word_starts(symbols: np.ndarray) -> np.ndarray:
    """Flags of the characters at which a word starts, chunk by chunk with a prefix scan in between."""
    nxt, flag, by_symbol, product, maps = _boundary_machine()
    n = len(symbols)
    rows = -(-n // CHUNK)
    grid = np.full(rows * CHUNK, PAD, dtype=np.uint8)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(rows, CHUNK).T)
    chunk_map = np.zeros(rows, dtype=np.int32)
    for column in grid:
        chunk_map = product[chunk_map, by_symbol[column]]
    step = 1
    while step < rows:
        chunk_map[step:] = product[chunk_map[:-step], chunk_map[step:]]
        step *= 2
    state = np.full(rows, START, dtype=np.int8)
    state[1:] = maps[chunk_map[:-1], START]
    starts = np.empty((CHUNK, rows), dtype=bool)
    for i, column in enumerate(grid):
        starts[i] = flag[state, column]
        state = nxt[state, column]
    return starts.T.reshape(-1)[:n]


class TokenMachine:
    """The token machine of one vocabulary file, compiled as its transitions are met."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, splitter = spec["model"], spec["pre_tokenizer"]
        plain = splitter["type"] == "ByteLevel" and splitter.get("use_regex", True) and not splitter.get("add_prefix_space")
        if model["type"] != "BPE" or not plain or spec.get("normalizer") or model.get("ignore_merges"):
            raise ValueError("only byte-level BPE without normaliser is supported")
        odd = [t for t in spec["added_tokens"] if t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]]
        if odd:
            raise ValueError(f"added tokens with strip or word rules: {odd}")
        self.added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        # Bytes without a visible character of their own are written as characters from 256 on.
        visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        letters = {chr(b): b for b in visible}
        letters |= {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(visible)))}
        vocab = model["vocab"]
        special = set(self.added)
        text_of = {i: bytes(letters[c] for c in token) for token, i in vocab.items() if token not in special}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.merge: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(pairs):
            self.merge[vocab[a], vocab[b]] = rank
            self.halves.setdefault(vocab[a + b], (vocab[a], vocab[b], rank))
        self._spines: tuple[dict, dict] = ({}, {})
        self.child: dict[int, int] = {}
        self.token = [-1]
        self.inner = [False]
        for i, text in text_of.items():
            node = 0
            for b in text:
                self.inner[node] = True
                key = node << 8 | b
                node = self.child.get(key, 0)
                if not node:
                    node = self.child[key] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(False)
            self.token[node] = i
        self._adjacent: dict[int, bool] = {}
        self.column = np.full(256, -1, dtype=np.int16)
        self.used = 0
        self._reset()

    def _reset(self) -> None:
        first = ((0, -1, 0),)
        self.states = [first]
        self.index = {first: 0}
        width = max(32, -(-self.used // 32) * 32)
        self.next = np.full((1024, width), -1, dtype=np.int32)
        self.delta = np.zeros((1024, width), dtype=np.int8)

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """``(token, rank at which it is formed)`` at one edge of ``token`` while it is merged; side 0 left, 1 right."""
        known = self._spines[side].get(token)
        if known is None:
            halves = self.halves.get(token)
            known = [(token, -1)] if halves is None else [*self._spine(halves[side], side), (token, halves[2])]
            self._spines[side][token] = known
        return known

    def _survive(self, before: int, token: int) -> bool:
        """Whether ``before`` and ``token`` stay two tokens when their bytes are merged together.

        The token left of the border grows along the right edge of ``before``, the one right of it along the left
        edge of ``token``. They are lost if the pair at the border may merge before one of the two has grown on;
        of equal ranks the leftmost merges first.
        """
        left, right = self._spine(before, 1), self._spine(token, 0)
        i = j = 0
        never = 1 << 30
        while True:
            grows_left = left[i + 1][1] if i + 1 < len(left) else never
            grows_right = right[j + 1][1] if j + 1 < len(right) else never
            rank = self.merge.get((left[i][0], right[j][0]), never)
            if rank < grows_left and rank <= grows_right and rank < never:
                return False
            if grows_left == grows_right == never:
                return True
            if grows_left <= grows_right:
                i += 1
            else:
                j += 1

    def _compile(self, state: int, byte: int) -> None:
        child, tokens, inner, adjacent = self.child, self.token, self.inner, self._adjacent
        grown, ended, change = [], -1, 0
        for node, before, count in self.states[state]:
            node = child.get(node << 8 | byte)
            if node is None:
                continue
            if inner[node]:
                grown.append((node, before, count))
            if ended < 0 and (token := tokens[node]) >= 0:
                if before < 0:
                    ended, change = token, count + 1
                    continue
                key = before << 32 | token
                known = adjacent.get(key)
                if known is None:
                    if len(adjacent) > MAX_PAIRS:
                        adjacent.clear()
                    known = adjacent[key] = self._survive(before, token)
                if known:
                    ended, change = token, count + 1
        if ended < 0:
            raise ValueError("the vocabulary is not closed under its merges")
        made = (*[(n, b, c - change) for n, b, c in grown], (0, ended, 0))
        target = self.index.get(made)
        if target is None:
            target = self.index[made] = len(self.states)
            self.states.append(made)
            if target == len(self.next):
                self.next = np.concatenate([self.next, np.full_like(self.next, -1)])
                self.delta = np.concatenate([self.delta, np.zeros_like(self.delta)])
        self.next[state, self.column[byte]] = target
        self.delta[state, self.column[byte]] = change

    def _columns(self, data: np.ndarray) -> np.ndarray:
        """Columns of the tables for bytes; a byte gets its column when it is first met."""
        met = np.flatnonzero(np.bincount(data, minlength=256))
        fresh = met[self.column[met] < 0]
        self.column[fresh] = np.arange(self.used, self.used + len(fresh))
        self.used += len(fresh)
        if self.used > self.next.shape[1]:
            more = ((0, 0), (0, -(-self.used // 32) * 32 - self.next.shape[1]))
            self.next = np.pad(self.next, more, constant_values=-1)
            self.delta = np.pad(self.delta, more)
        return self.column[data]

    def words(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Number of tokens of every word ``data[start : start + size]``."""
        if len(self.states) > MAX_STATES:
            self._reset()
        columns = self._columns(data)
        order = np.argsort(-sizes, kind="stable")
        place, left = starts[order], sizes[order]
        state = np.zeros(len(order), dtype=np.int32)
        total = np.zeros(len(order), dtype=np.int64)
        alive = len(order)
        # Words of equal length end together; searchsorted over the falling sizes says how many go on.
        falling = -left
        for i in range(int(left[0]) if alive else 0):
            alive = int(np.searchsorted(falling, -i, side="left"))
            now, at = state[:alive], place[:alive] + i
            column = columns[at]
            target = self.next[now, column]
            lacking = np.flatnonzero(target < 0)
            if len(lacking):
                for key in np.unique(now[lacking].astype(np.int64) << 8 | data[at[lacking]]).tolist():
                    self._compile(key >> 8, key & 255)
                target[lacking] = self.next[now[lacking], column[lacking]]
            total[:alive] += self.delta[now, column]
            state[:alive] = target
        out = np.empty(len(order), dtype=np.int64)
        out[order] = total
        return out

    def count_long(self, text: str, size: int) -> tuple[int, int]:
        """UTF-8 bytes and tokens of one text, read in pieces of about ``size`` characters.

        A word always begins where a letter is followed by a character of ASCII that is none, whatever comes before or
        after, so the pieces between such places have the words of the whole. A run without any is one piece.
        """
        parts = [text]
        for special in self.added:
            if special in text:
                parts = [p for part in parts for p in part.split(special)]
        n_tokens = len(parts) - 1
        for part in parts:
            lo = 0
            while lo < len(part):
                cut = _CUT.search(part, lo + size)
                hi = cut.start() if cut else len(part)
                n_tokens += int(self.count([part[lo:hi]])[1][0])
                lo = hi
        return len(text.encode("utf-8", "surrogatepass")), n_tokens

    def count(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes and tokens of every text of a block."""
        extra = np.zeros(len(texts), dtype=np.int64)
        pieces: list[str] = []
        owner: list[int] = []
        for i, text in enumerate(texts):
            parts = [text]
            for special in self.added:
                if special in text:
                    parts = [p for part in parts for p in part.split(special)]
            extra[i] = len(parts) - 1
            pieces += parts
            owner += [i] * len(parts)
        joined = "\n".join(pieces) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
        sizes = np.array([len(p) for p in pieces])
        ends = np.zeros(len(points), dtype=bool)
        ends[np.cumsum(sizes + 1) - 1] = True
        starts = _word_starts(_symbols(points, ends))
        width = np.ones(len(points), dtype=np.int64)
        for bound in (0x80, 0x800, 0x10000):
            width += points >= bound
        offset = np.cumsum(width) - width
        marks = np.flatnonzero(starts | ends)
        word = starts[marks]
        begin = offset[marks]
        length = np.diff(np.append(begin, offset[-1]))[word]
        data = np.frombuffer(joined.encode("utf-8"), dtype=np.uint8)
        tokens = self.words(data, begin[word], length)
        piece = np.searchsorted(np.flatnonzero(ends), marks[word], side="left")
        owners = np.array(owner)
        out = extra + np.bincount(owners[piece], weights=tokens, minlength=len(texts)).astype(np.int64)
        n_bytes = np.add.reduceat(width, np.append(0, np.cumsum(sizes + 1)[:-1])) - 1
        total = np.bincount(owners, weights=n_bytes, minlength=len(texts)).astype(np.int64)
        if extra.any():
            total = np.array([len(t.encode()) if e else n for t, e, n in zip(texts, extra, total)])
        return total, out


@lru_cache(maxsize=2)
def machine(path: str) -> TokenMachine:
    return TokenMachine(path)


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, n_tokens)`` for every row: tokens as the library for the file at ``path`` counts them.

    No begin, end or other tokens are added; the file's own special strings inside a text count as one token each,
    which is the library's default. Rows are neither dropped nor merged, so repeated rows give repeated results. A
    NULL text counts as empty: no bytes, no tokens. Other columns are not read, whatever their names. One narrow
    pass, no shuffle; memory follows the block size and the length of a text as such, not the number of rows.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = machine(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            sizes, tokens = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for lo, hi in chunks_by_size(texts, BLOCK_CHARS):
                if hi - lo == 1 and len(texts[lo]) > BLOCK_CHARS:
                    sizes[lo], tokens[lo] = own.count_long(texts[lo], BLOCK_CHARS)
                else:
                    sizes[lo:hi], tokens[lo:hi] = own.count(texts[lo:hi])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(tokens)], names=[id_col, "n_bytes", "n_tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    texts = df.select(F.col(id_col), F.col(text_col))
    return texts.mapInArrow(counted, f"`{id_col}` {kind}, n_bytes long, n_tokens long")
