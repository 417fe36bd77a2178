"""Encoding and decoding with a merge-type SentencePiece vocabulary and seeded merge-dropout (operator 7).

Merges run over an agenda, best piece first and leftmost among equals. Every candidate that comes up is skipped if a
keyed hash of the seed, the document, the chunk's place in its text and the candidate's number falls below the rate; it
comes back only if a neighbour changes. So a word is split anew wherever it stands, and the same document, copy and seed
give the same pieces again. Each decodes to the very text. With a rate of 0 the pieces are those of the library.

No piece has a space mark behind another character or a line break, so merges never cross from one chunk (space marks,
then other characters, or line breaks) to the next. The chunks of many texts are merged side by side: one step takes the
best candidate of each chunk, looks the new pairs up in one hash table, and goes on with the chunks that have one left.
Nothing is remembered from one text to the next.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import sentencepiece
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factengine.llm.common import free_name

#: The vocabulary's mark for a space; the same character in a text is spelt in bytes, so that decoding can tell them.
MARK = "▁"
#: Where the public vocabulary lies by default; a parameter everywhere.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Chunks of up to this length are merged side by side, longer ones one by one with a heap; the result is the same.
LONGEST = 63
#: Chunks that are merged side by side, characters that are encoded and ids that are decoded at once.
ROWS, CHARS, IDS = 4096, 1 << 20, 1 << 18
#: No candidate; steps of places and of draws; all bits of a word.
FAR, PLACE, DRAW, WORD = (1 << 31) - 1, 0xC2B2AE3D27D4EB4F, 0x9E3779B97F4A7C15, (1 << 64) - 1


def mixed(x):
    """The 64-bit finaliser of splitmix, of a number below 2**64 or an array of unsigned ones."""
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & WORD
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & WORD
    return x ^ (x >> 31)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions ``start, start + 1, ...`` of all runs, one run after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class Pairs:
    """The piece that two neighbouring symbols make and its order, from an open hash table over arrays."""

    def __init__(self, merged: dict[tuple[int, int], tuple[int, int]], symbols: int):
        self.symbols, bits = symbols, max(10, (8 * len(merged)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.key = np.full(1 << bits, -1, dtype=np.int64)
        self.order, self.piece = np.full(1 << bits, FAR >> 6, dtype=np.int32), np.zeros(1 << bits, dtype=np.int32)
        keys = np.array([a * symbols + b for a, b in merged], dtype=np.int64)
        for key, at, (order, piece) in zip(keys.tolist(), self._slot(keys).tolist(), merged.values(), strict=True):
            while self.key[at] >= 0:
                at = at + 1 & self.last
            self.key[at], self.order[at], self.piece[at] = key, order, piece

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(DRAW)) >> self.shift).view(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(order, piece)`` of each pair; the order is FAR >> 6 if it makes none."""
        keys = left.astype(np.int64) * self.symbols + right
        at = self._slot(keys)
        there = self.key[at]
        open_ = np.flatnonzero((there != keys) & (there >= 0))
        while len(open_):
            at[open_] = at[open_] + 1 & self.last
            there = self.key[at[open_]]
            open_ = open_[(there != keys[open_]) & (there >= 0)]
        return np.where(self.key[at] == keys, self.order[at], FAR >> 6), self.piece[at]


class Encoder:
    """A vocabulary with its merges; ``rate`` is the share of merge candidates that are skipped."""

    def __init__(self, model: bytes, rate: float = 0.1, seed: int = 1):
        processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = processor.get_piece_size()
        self.pieces = [processor.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (processor.is_control(i) or processor.is_unknown(i) or processor.is_byte(i) or processor.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        # the better a piece, the smaller its order; equal scores keep one order
        scores = sorted({processor.get_score(i) for i in plain}, reverse=True)
        place = {s: n for n, s in enumerate(scores)}
        self.order = {self.pieces[i]: place[processor.get_score(i)] for i in plain}
        self.bytes = np.array([processor.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int32)
        if any(not processor.is_byte(i) for i in self.bytes.tolist()):
            raise ValueError("the vocabulary has no byte pieces, so texts may not decode")
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.ids):
            raise ValueError("a piece goes over the end of a word or line")
        self.rate, self.seed = rate, seed
        self.skipped_below = min(int(rate * 2.0**64), WORD) if rate < 1 else WORD + 1
        # symbols: ids of pieces, then a number per character that is no piece
        self.odd = size
        self.symbol = np.arange(0x110000, dtype=np.int32) + size
        for piece, i in self.ids.items():
            if len(piece) == 1 and piece != MARK:
                self.symbol[ord(piece)] = i
        self.symbol[ord(" ")] = self.ids.get(MARK, size + ord(" "))
        number = lambda s: self.ids.get(s, self.odd + ord(s) if len(s) == 1 else None)
        merged = {}
        for piece, i in self.ids.items():
            for k in range(1, len(piece)):
                a, b = number(piece[:k]), number(piece[k:])
                if a is not None and b is not None:
                    merged[a, b] = (self.order[piece], i)
        self.pairs = Pairs(merged, size + 0x110000)
        shown = [bytes([b]) if (b := {int(x): n for n, x in enumerate(self.bytes)}.get(i)) is not None else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        self.shown, self.width = np.frombuffer(b"".join(shown), dtype=np.uint8), np.array([len(s) for s in shown], dtype=np.int64)
        self.start = np.cumsum(self.width) - self.width

    def _skips(self, states: np.ndarray, nth: int) -> np.ndarray:
        """Whether the candidate of this number, from 0, is skipped at each place."""
        if self.skipped_below > WORD:
            return np.ones(len(states), dtype=bool)
        return mixed(states + np.uint64(DRAW * (nth + 1) & WORD)) < np.uint64(self.skipped_below)

    def _merge(self, symbols: np.ndarray, states: np.ndarray) -> np.ndarray:
        """The symbols of chunks side by side, ``(place, chunk)`` with -1 behind each chunk's end, after all merges;
        -1 where a symbol went into its left neighbour."""
        longest, n = symbols.shape
        sym = np.full((longest + 1, n), -1, dtype=np.int32)  # the last row is no place
        sym[:longest] = symbols
        after = np.repeat(np.arange(1, longest + 2, dtype=np.int8)[:, None], n, axis=1)
        before = np.repeat(np.arange(-1, longest, dtype=np.int8)[:, None], n, axis=1)
        before[0] = longest
        key = np.full((longest + 1, n), FAR, dtype=np.int32)  # order * 64 + place: the least is best, then leftmost
        piece = np.zeros((longest + 1, n), dtype=np.int32)
        at = np.flatnonzero(sym[1:] >= 0)
        order, piece.ravel()[at] = self.pairs(sym.ravel()[at], sym.ravel()[at + n])
        key.ravel()[at] = np.where(order < FAR >> 6, (order << 6) + at // n, FAR)
        out, rows, nth = sym, np.arange(n), 0
        while True:
            best = key[:longest].min(axis=0)
            live = best != FAR
            if not live.any():
                break
            if live.sum() * 4 < 3 * len(live):  # go on with the chunks that have candidates
                if out is not sym:
                    out[:, rows] = sym
                rows, best, states = rows[live], best[live], states[live]
                sym, after, before, key, piece = (np.compress(live, x, axis=1) for x in (sym, after, before, key, piece))
                live = np.ones(len(rows), dtype=bool)
            width = sym.shape[1]
            skip = self._skips(states, nth) & live
            nth += 1
            flat_sym, flat_key, flat_piece, flat_after, flat_before = (x.reshape(-1) for x in (sym, key, piece, after, before))
            spot = (best & 63).astype(np.int64) * width + np.arange(width)
            flat_key[spot[skip]] = FAR
            row = np.flatnonzero(live & ~skip)
            i = spot[row]
            j = flat_after[i].astype(np.int64) * width + row
            new = flat_piece[i]
            flat_sym[i], flat_sym[j], flat_key[j] = new, -1, FAR
            k = flat_after[j]
            k = np.where(k > longest, longest, k).astype(np.int64)
            flat_after[i] = k
            k = k * width + row
            flat_before[k] = best[row] & 63
            p = flat_before[i].astype(np.int64) * width + row
            first, second = np.concatenate((p, i)), np.concatenate((i, k))
            order, made = self.pairs(np.concatenate((flat_sym[p], new)), np.concatenate((new, flat_sym[k])))
            # a symbol of -1 is no neighbour
            order = np.where((flat_sym[first] < 0) | (flat_sym[second] < 0), FAR >> 6, order)
            flat_key[first] = np.where(order < FAR >> 6, (order << 6) + (first // width).astype(np.int32), FAR)
            flat_piece[first] = made
        if out is not sym:
            out[:, rows] = sym
        return out[:longest]

    def _merge_long(self, symbols: list[int], state: int) -> list[int]:
        """One chunk of any length, with a heap."""
        n, nth = len(symbols), 0
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        agenda: list[tuple[int, int, int, int, int]] = []

        def add(starts: list[int]) -> None:
            starts = [i for i in starts if i >= 0 and after[i] >= 0]
            if starts:
                order, piece = self.pairs(np.array([symbols[i] for i in starts]), np.array([symbols[after[i]] for i in starts]))
                for i, o, p in zip(starts, order.tolist(), piece.tolist(), strict=True):
                    if o < FAR >> 6:
                        heapq.heappush(agenda, (o, i, symbols[i], symbols[after[i]], p))

        add(list(range(n - 1)))
        while agenda:
            _, i, left, right, piece = heapq.heappop(agenda)
            j = after[i]
            if j < 0 or symbols[i] != left or symbols[j] != right:
                continue
            nth += 1
            if mixed(state + DRAW * nth & WORD) < self.skipped_below:
                continue
            symbols[i], symbols[j] = piece, -1
            after[i], after[j] = after[j], -1
            if after[i] >= 0:
                before[after[i]] = i
            add([before[i], i])
        return [s for s in symbols if s >= 0]

    def _spelt(self, symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of symbols, characters that are no piece in bytes; ``ends`` are the ends of runs of symbols."""
        odd = np.flatnonzero(symbols >= self.odd)
        if not len(odd):
            return symbols, ends
        spelt = [self.bytes[np.frombuffer(chr(c).encode("utf-8", "surrogatepass"), dtype=np.uint8)] for c in (symbols[odd] - self.odd).tolist()]
        lengths = np.ones(len(symbols), dtype=np.int64)
        lengths[odd] = [len(s) for s in spelt]
        at = np.concatenate(([0], np.cumsum(lengths)))
        out = np.repeat(symbols, lengths)
        out[spread(at[odd], lengths[odd])] = np.concatenate(spelt)
        return out, at[ends]

    def _encode_chars(self, chars: np.ndarray, firsts: np.ndarray, keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(ids, ends, chunks)`` of texts that begin at ``firsts``, each with its leading space and its first chunk's
        place: the ids of all, where each text's end, and how many chunks each has."""
        space, line = chars == 32, chars == 10
        gone = lambda x: np.concatenate(([False], x[:-1]))
        begins = space & ~gone(space) | line & ~gone(line) | ~space & ~line & gone(line)
        begins[firsts] = True
        begins = np.flatnonzero(begins)
        length = np.diff(np.append(begins, len(chars)))
        lead = np.searchsorted(begins, firsts)
        chunks = np.diff(np.append(lead, len(begins)))
        nth = np.arange(len(begins)) - np.repeat(lead, chunks) + np.repeat(places, chunks) + 1
        states = mixed(nth.astype(np.uint64) * np.uint64(PLACE) + np.repeat(keys, chunks))
        symbols = self.symbol[chars]
        made: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # chunks, their numbers of symbols, symbols
        by_length = np.argsort(length, kind="stable")
        short = int(np.searchsorted(length[by_length], LONGEST, side="right"))
        for a in range(0, short, ROWS):
            own = by_length[a : min(a + ROWS, short)]
            longest = int(length[own[-1]])
            grid = np.full((longest, len(own)), -1, dtype=np.int32)
            for k in range(longest):
                has = np.searchsorted(length[own], k, side="right")  # lengths ascend
                grid[k, has:] = symbols[begins[own[has:]] + k]
            grid = np.ascontiguousarray((self._merge(grid, states[own]) if longest > 1 else grid).T)
            made.append((own, (grid >= 0).sum(axis=1), grid[grid >= 0]))
        for c in by_length[short:].tolist():
            found = self._merge_long(symbols[begins[c] : begins[c] + length[c]].tolist(), int(states[c]))
            made.append((np.array([c]), np.array([len(found)]), np.array(found, dtype=np.int32)))
        counts = np.zeros(len(begins), dtype=np.int64)
        for own, n, _ in made:
            counts[own] = n
        ends = np.cumsum(counts)
        out = np.empty(int(ends[-1]), dtype=np.int32)
        for own, n, found in made:
            out[spread(ends[own] - n, n)] = found
        ids, ends = self._spelt(out, ends[lead + chunks - 1])
        return ids, ends, chunks

    def encode_many(self, texts: list[str | None], keys: list[int]) -> list[np.ndarray]:
        """Token ids of whole texts; none for null and empty ones. A key stands for a document and its copy."""
        base = np.array([xxhash.xxh64_intdigest(f"{self.seed}:{k}".encode()) for k in keys], dtype=np.uint64)
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int32)] * len(texts)
        held: list[int] = []

        def flush() -> None:
            if held:
                chars = np.frombuffer("".join(f" {texts[i]}" for i in held).encode("utf-32-le", "surrogatepass"), dtype=np.int32)
                sizes = np.array([len(texts[i]) + 1 for i in held])
                ids, ends, _ = self._encode_chars(chars, np.cumsum(sizes) - sizes, base[held], np.zeros(len(held), dtype=np.int64))
                for i, own in zip(held, np.split(ids, ends[:-1]), strict=True):
                    out[i] = own
                held.clear()

        size = 0
        for i, text in enumerate(texts):
            if not text:
                continue
            if len(text) > CHARS:
                out[i] = self._encode_long(text, base[i : i + 1])
                continue
            if size + len(text) > CHARS:
                flush()
                size = 0
            held.append(i)
            size += len(text) + 1
        flush()
        return out

    def _encode_long(self, text: str, key: np.ndarray) -> np.ndarray:
        """A long text in parts that end where a chunk does."""
        out, at, place, size = [], 0, 0, len(text)
        while at < size:
            to = text.find(" ", at + CHARS)
            while to > 0 and text[to - 1] == " ":
                to = text.find(" ", to + 1)
            to = size if to < 0 else to
            part = text[at:to] if at else f" {text[:to]}"
            chars = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.int32)
            ids, _, chunks = self._encode_chars(chars, np.zeros(1, dtype=np.int64), key, np.array([place]))
            out.append(ids)
            at, place = to, place + int(chunks[0])
        return np.concatenate(out)

    def encode(self, text: str, key: int = 0) -> list[int]:
        """Token ids of one text; an empty text has none."""
        return self.encode_many([text], [key])[0].tolist()

    def decode_many(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(bytes, ends)`` of the texts whose ids end at ``ends``, byte pieces joined, without the leading mark."""
        width = self.width[ids]
        at = np.concatenate(([0], np.cumsum(width)))
        parts = [self.shown[spread(self.start[ids[i : i + IDS]], width[i : i + IDS])] for i in range(0, len(ids), IDS)]
        data = np.concatenate([*parts, np.zeros(0, dtype=np.uint8)])
        begins, stops = at[np.concatenate(([0], ends[:-1]))], at[ends]
        led = np.flatnonzero((stops > begins) & (data[np.minimum(begins, max(0, len(data) - 1))] == 32)) if len(data) else begins[:0]
        keep = np.ones(len(data), dtype=bool)
        keep[begins[led]] = False
        lengths = stops - begins
        lengths[led] -= 1
        return data[keep], np.cumsum(lengths)

    def decode(self, ids: list[int]) -> str:
        """The text of one list of ids."""
        data, _ = self.decode_many(np.array(ids, dtype=np.int64), np.array([len(ids)]))
        return data.tobytes().decode("utf-8", "surrogatepass")


def ship_model(df: DataFrame, model: str = MODEL) -> str:
    """Sends the vocabulary file to the executors; returns the name under which a task finds it."""
    df.sparkSession.sparkContext.addFile(model)
    return model.rsplit("/", 1)[-1]


_ENCODERS: dict[tuple, Encoder] = {}


def _encoder(name: str, rate: float, seed: int) -> Encoder:
    """A worker's encoder for a shipped vocabulary; it is kept from one task to the next."""
    with open(SparkFiles.get(name), "rb") as f:
        model = f.read()
    key = (xxhash.xxh3_128_digest(model), rate, seed)
    if key not in _ENCODERS:
        if len(_ENCODERS) > 1:
            _ENCODERS.clear()
        _ENCODERS[key] = Encoder(model, rate, seed)
    return _ENCODERS[key]


def encode(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", rate: float = 0.1, seed: int = 1, model: str = MODEL, out_col: str = "token_ids", copy_col: str | None = None) -> DataFrame:
    """``docs`` with ``out_col``, the token ids of each whole text; null for null, none for an empty text.

    The draws depend on a row's id, text and, if ``copy_col`` is given, its copy (see :func:`factengine.llm.common.numbered_copies`); without it rows
    that repeat an id and a text have equal ids. A text of any length is encoded whole, in parts that end between two
    chunks. A column named ``out_col`` is replaced; other columns stay as they are. An empty table gives no rows. No
    shuffle.
    """
    name = ship_model(docs, model)
    docs = docs.drop(out_col)
    key = free_name(docs.columns, "__spm_key")
    rows = docs.withColumn(key, F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col), F.col(copy_col) if copy_col else F.lit(1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(name, rate, seed)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = part.column(text_col).to_pylist()
                ids = encoder.encode_many(texts, part.column(key).to_pylist())
                ends = np.cumsum([0, *(len(x) for x in ids)]).astype(np.int32)
                none = pa.array([t is None for t in texts])
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)), mask=none)
                kept = [c for c in part.schema.names if c != key]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), lists], [*kept, out_col])

    return rows.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out_col, T.ArrayType(T.IntegerType()))]))


def decode(docs: DataFrame, ids_col: str = "token_ids", model: str = MODEL, out_col: str = "decoded") -> DataFrame:
    """``docs`` with ``out_col``, the text of the ids; null for null, an empty text for no ids. Ids that spell no valid
    text, which no encoding yields, are an error. No shuffle."""
    name = ship_model(docs, model)
    docs = docs.drop(out_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _encoder(name, 0.0, 0)
        for batch in batches:
            lengths = np.diff(batch.column(ids_col).offsets.to_numpy()).astype(np.int64)
            at = 0
            while at < batch.num_rows:
                to = at + max(1, int(np.searchsorted(np.cumsum(lengths[at : at + 1000]), IDS, side="right")))
                part = batch.slice(at, to - at)
                column = part.column(ids_col)
                ends = column.offsets.to_numpy()
                flat = column.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
                data, stops = decoder.decode_many(flat, ends[1:].astype(np.int64) - ends[0])
                texts = pa.StringArray.from_buffers(len(stops), pa.py_buffer(np.concatenate(([0], stops)).astype(np.int32)), pa.py_buffer(data))
                texts.validate(full=True)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.compute.if_else(column.is_valid(), texts, pa.scalar(None, pa.string()))], [*part.schema.names, out_col])
                at = to

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out_col, T.StringType())]))
