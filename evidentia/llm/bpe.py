"""Byte-level BPE encoding and decoding: speculate and verify.

Texts fall into chunks (white space and what follows it), chunks into words by the vocabulary's own splitting rule. Of each new word:

1. *Speculate.* Greedy longest match over its bytes, by an automaton of all tokens, proposes tokens.
2. *Verify.* A proposal is what merging would give if and only if every two neighbours are compatible: no merge would ever join them across their
   boundary. All pairs of a batch are tested at once with numpy, by walking down the right edge of one token's merge tree and the left edge of
   the other's, always undoing the later merge.
3. Only words with an incompatible pair are merged exactly, all of a batch side by side, a merge of each a step.

Distinct chunks of a batch are found by Arrow and looked up in a cache of two generations, bounded by bytes, so that a text costs no Python object per
chunk. Vocabulary files are read where executors run; their place is a parameter.
"""

from __future__ import annotations

import functools
import heapq
import json
import operator
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Generations, chunks_of, expand, map_batches, objects, string_buffers, tune

#: Bytes of the chunks that a worker remembers, and their ids.
CACHE_BYTES = 96 << 20
#: Longer words are merged one by one.
SIDE_BY_SIDE = 64
#: White space beyond ASCII, as UTF-8: with it in a text, chunks can't be told from their own bytes.
_WIDE_SPACE = re.compile(b"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
_PLAIN = re.compile(rf"[\t-\r -~{_LETTER}]*")
#: The splitting rule of byte-level BPE, for texts of the characters of _PLAIN.
_WORD = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTER}]+| ?[0-9]+| ?[^\s{_LETTER}0-9]+|\s+(?!\S)|\s+")
#: Between words in the automaton's text: no byte, so in no token.
_GAP = "Ā"
_BLANK = b" \t\n\r\f\v"
#: First bytes of _WIDE_SPACE.
_WIDE_LEAD = np.zeros(256, bool)
_WIDE_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_SECOND = operator.itemgetter(1)


def _byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and words of a byte-level BPE file."""

    def __init__(self, path: str):
        import ahocorasick
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, alphabet = file["model"], _byte_alphabet()
        if file.get("normalizer") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges"):
            raise ValueError("not a plain byte-level BPE vocabulary")
        self.split = Tokenizer.from_file(path).pre_tokenizer
        self.alphabet = alphabet
        self.id_of = {bytes(alphabet[c] for c in token): i for token, i in model["vocab"].items()}
        if any(bytes([b]) not in self.id_of for b in range(256)):
            raise ValueError("the vocabulary lacks a byte")
        self.byte_id = np.array([self.id_of[bytes([b])] for b in range(256)], np.int64)
        self.special = {t["content"].encode(): t["id"] for t in file["added_tokens"]}
        self.any_special = re.compile(b"(" + b"|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + b")") if self.special else None
        n = max([*self.id_of.values(), *self.special.values()]) + 1
        bytes_of = [b""] * n
        for token, i in [*self.id_of.items(), *self.special.items()]:
            bytes_of[i] = token
        self.bytes_of = pa.array(bytes_of, pa.binary())
        self.length = _sizes(bytes_of)
        self.tokens = ahocorasick.Automaton()
        for token, i in self.id_of.items():
            self.tokens.add_word(token.decode("latin-1"), i)
        self.tokens.make_automaton()
        self.left, self.right, self.rank = np.full(n, -1), np.full(n, -1), np.full(n, -1)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        self.regular = True
        raw = model["vocab"]
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, z = raw[a], raw[b], raw[a + b]
            self.merge[x, y] = rank, z
            self.regular &= self.rank[z] < 0 and self.rank[x] < rank and self.rank[y] < rank
            self.left[z], self.right[z], self.rank[z] = x, y, rank
        self.base, self.never = n, len(self.merge) + 1
        self.made = np.array([z for _, z in sorted(self.merge.values())] + [0, 0])
        codes = np.array([x * n + y for x, y in self.merge], np.int64)
        order = np.argsort(codes)
        self.codes, self.code_rank = codes[order], np.array([r for r, _ in self.merge.values()])[order]
        self.chunks = Generations(CACHE_BYTES)

    def ranks(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair; `never` without one."""
        code = x * self.base + y
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.code_rank[at], self.never)

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words by greedy longest match, and where each word's end."""
        text = _GAP.join([w.decode("latin-1") for w in words])
        flat = np.fromiter(map(_SECOND, self.tokens.iter_long(text)), np.int64)
        return flat, np.searchsorted(np.cumsum(self.length[flat]), np.cumsum(_sizes(words)), "left") + 1

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves the boundary between tokens a and b, pairwise."""
        ok, todo = np.ones(len(a), bool), np.arange(len(a))
        x, y = a.copy(), b.copy()
        above_x, above_y = np.full(len(a), self.never), np.full(len(a), self.never)
        while len(todo):
            rank = self.ranks(x, y)
            # a merge of the same rank further left comes first
            joined = (rank < above_x) & (rank <= above_y) & (rank < self.never)
            ok[todo[joined]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~joined & ((rx >= 0) | (ry >= 0))
            todo, x, y, rx, ry, above_x, above_y = (v[go] for v in (todo, x, y, rx, ry, above_x, above_y))
            undo = rx > ry
            above_x, above_y = np.where(undo, rx, above_x), np.where(undo, above_y, ry)
            x, y = np.where(undo, self.right[x], x), np.where(undo, y, self.left[y])
        return ok

    def merged(self, word: bytes) -> list[int]:
        """Exact merging of one word, in n log n steps."""
        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        heap = [(r[0], k, ids[k], ids[k + 1], r[1]) for k in range(len(ids) - 1) if (r := self.merge.get((ids[k], ids[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, k, x, y, z = heapq.heappop(heap)
            nxt = after[k]
            if ids[k] != x or nxt < 0 or ids[nxt] != y:
                continue
            ids[k], ids[nxt] = z, -1
            after[k] = after[nxt]
            if after[k] >= 0:
                before[after[k]] = k
            for p, q in ((before[k], k), (k, after[k])):
                if p >= 0 and q >= 0 and (r := self.merge.get((ids[p], ids[q]))):
                    heapq.heappush(heap, (r[0], p, ids[p], ids[q], r[1]))
        return [i for i in ids if i >= 0]

    def merged_side_by_side(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of many words: tokens of all of them, and the word of each. A step merges each word's first pair of lowest rank."""
        ids = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        own = np.repeat(np.arange(len(words)), [len(w) for w in words])
        rank = np.full(len(ids), self.never)
        rank[:-1] = np.where(own[1:] == own[:-1], self.ranks(ids[:-1], ids[1:]), self.never)
        done = []
        while len(ids):
            starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            lowest = np.minimum.reduceat(rank, starts)
            sizes = np.diff(starts, append=len(ids))
            over = lowest == self.never
            if over.any():
                held = np.repeat(over, sizes)
                done.append((own[held], ids[held]))
                ids, own, rank = ids[~held], own[~held], rank[~held]
                if not len(ids):
                    break
                lowest, sizes = lowest[~over], sizes[~over]
            hit = np.flatnonzero(rank == np.repeat(lowest, sizes))
            first = hit[np.concatenate([[True], own[hit[1:]] != own[hit[:-1]]])]
            ids[first] = self.made[lowest]
            keep = np.ones(len(ids), bool)
            keep[first + 1] = False
            ids, own, rank = ids[keep], own[keep], rank[keep]
            at = first - np.arange(len(first))  # each word has lost one token before the next word's
            for k in (at, at[at > 0] - 1):
                k = k[k + 1 < len(ids)] if len(k) and k[-1] + 1 >= len(ids) else k
                rank[k] = np.where(own[k] == own[k + 1], self.ranks(ids[k], ids[k + 1]), self.never)
            if at[-1] == len(ids) - 1:
                rank[-1] = self.never
        word, ids = np.concatenate([w for w, _ in done]), np.concatenate([i for _, i in done])
        order = np.argsort(word, kind="stable")
        return ids[order], word[order]

    def ids_of_words(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of each word."""
        flat, ends = self.propose(words)
        count = np.diff(ends, prepend=0)
        of = np.repeat(np.arange(len(words)), count)
        inner = np.flatnonzero(of[1:] == of[:-1])
        wrong = np.zeros(len(words), bool)
        if len(inner):
            pairs, where = np.unique(flat[inner] * self.base + flat[inner + 1], return_inverse=True)
            ok = self.compatible(pairs // self.base, pairs % self.base) if self.regular else np.zeros(len(pairs), bool)
            wrong[of[inner[~ok[where]]]] = True
        packed = _slices(flat, ends)
        long = [k for k in np.flatnonzero(wrong).tolist() if len(words[k]) > SIDE_BY_SIDE]
        for k in long:
            packed[k] = np.array(self.merged(words[k]), "<u4").tobytes()
        wrong[long] = False
        few = np.flatnonzero(wrong)
        if len(few):
            ids, word = self.merged_side_by_side([words[k] for k in few.tolist()])
            for k, own in zip(few.tolist(), _slices(ids, np.searchsorted(word, np.arange(len(few)), "right")), strict=True):
                packed[k] = own
        return packed

    def words(self, chunks: list[bytes]) -> tuple[list[bytes], np.ndarray]:
        """Words of all chunks, and where each chunk's end."""
        text = b"".join(chunks).decode()
        # where each chunk begins with white space and ends with a word, all together split as each does
        if _PLAIN.fullmatch(text) and all(c[0] in _BLANK and c[-1] not in _BLANK for c in chunks):
            words = [w.encode() for w in _WORD.findall(text)]
            return words, np.searchsorted(np.cumsum(_sizes(words)), np.cumsum(_sizes(chunks)), "left") + 1
        split = []
        for c in chunks:
            text = c.decode()
            if _PLAIN.fullmatch(text):
                split.append([w.encode() for w in _WORD.findall(text)])
            else:
                split.append([bytes(self.alphabet[x] for x in w) for w, _ in self.split.pre_tokenize_str(text)])
        return list(chain.from_iterable(split)), np.cumsum(_sizes(split))

    def ids_of_chunks(self, chunks: list[bytes]) -> list[bytes]:
        """Packed ids of new chunks."""
        regular = [k for k, c in enumerate(chunks) if c[0] in _BLANK and c[-1] not in _BLANK]
        if 0 < len(regular) < len(chunks):  # the others, few, do not keep these from being split together
            out = [b""] * len(chunks)
            for places in (regular, sorted(set(range(len(chunks))).difference(regular))):
                for k, own in zip(places, self.ids_of_chunks([chunks[k] for k in places]), strict=True):
                    out[k] = own
            return out
        words, ends = self.words(chunks)
        known: dict[bytes, int] = {}
        of = np.array([known.setdefault(w, len(known)) for w in words], np.int32)
        packed = pa.array(self.ids_of_words(list(known)), pa.binary()).take(pa.array(of))
        _, offsets, data = packed.buffers()
        at = np.concatenate([[0], np.frombuffer(offsets, np.int32)[: len(words) + 1][ends]]).astype(np.int32)
        return objects(pa.Array.from_buffers(pa.binary(), len(chunks), [None, pa.py_buffer(at), data]))

    def _odd(self, text: bytes) -> bytes:
        """Ids of a text with special tokens or wide white space: its words, each standing for itself."""
        made = []
        for k, piece in enumerate(self.any_special.split(text) if self.any_special else [text]):
            if k % 2:
                made.append(self.special[piece].to_bytes(4, "little"))
            elif piece:
                words = [bytes(self.alphabet[c] for c in w) for w, _ in self.split.pre_tokenize_str(piece.decode())]
                known = dict(zip(own := list(set(words)), self.ids_of_words(own), strict=True))
                made += map(known.__getitem__, words)
        return b"".join(made)

    def encode_column(self, column: pa.Array) -> pa.Array:
        """Ids of each text of an Arrow column, null being empty, as little-endian unsigned 32-bit integers."""
        whole = column.cast(pa.string()).fill_null("").cast(pa.binary())
        data, _ = string_buffers(whole)
        odd: dict[int, bytes] = {}
        # most batches have neither, which a look at all their bytes tells
        if any(s in data.tobytes() for s in self.special) or _WIDE_LEAD[data].any():
            texts = whole.to_pylist()
            odd = {k: self._odd(t) for k, t in enumerate(texts) if any(s in t for s in self.special) or (not t.isascii() and _WIDE_SPACE.search(t))}
            if odd:
                whole = pa.array([b"" if k in odd else t for k, t in enumerate(texts)], pa.binary())
        chunks, of_text = chunks_of(whole)
        made = expand(chunks, of_text, self.chunks, self.ids_of_chunks)
        if odd:
            made = pa.array([odd.get(k, x) for k, x in enumerate(made.to_pylist())], pa.binary())
        return made

    def decode_column(self, column: pa.Array) -> pa.Array:
        """Texts of packed ids, null staying null; bytes that are no UTF-8 become U+FFFD."""
        own = column.cast(pa.binary()).fill_null(b"")
        if not len(own):
            return pa.array([], pa.string())
        _, offsets, data = own.buffers()
        at = np.frombuffer(offsets, np.int32)[own.offset : own.offset + len(own) + 1].astype(np.int64)
        ids = np.frombuffer(data, "<u4", (at[-1] - at[0]) // 4, at[0]) if at[-1] > at[0] else np.zeros(0, "<u4")
        tokens = self.bytes_of.take(pa.array(ids))
        _, ends, made = tokens.buffers()
        ends = np.frombuffer(ends, np.int32)[: len(tokens) + 1] if len(tokens) else np.zeros(1, np.int32)
        places = ends[(at - at[0]) // 4].astype(np.int32)
        texts = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(places), made if made is not None else pa.py_buffer(b"")])
        try:
            texts = texts.cast(pa.string())
        except pa.ArrowInvalid:
            texts = pa.array([t.decode("utf-8", "replace") for t in texts.to_pylist()], pa.string())
        return pa.compute.if_else(column.is_valid(), texts, pa.scalar(None, pa.string())) if column.null_count else texts


def _sizes(parts: list) -> np.ndarray:
    return np.fromiter(map(len, parts), np.int64, len(parts))


def _slices(ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
    data, ends = ids.astype("<u4").tobytes(), (ends * 4).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids): token ids of each whole text as little-endian unsigned 32-bit integers, special tokens' strings being special tokens.

    A null or empty text has no ids. Rows are neither dropped nor joined: equal rows give equal rows, an empty table an empty result; other
    columns are ignored.
    """
    tune(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        own = vocabulary(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), own.encode_column(batch.column(1))], ["id", "ids"])

    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), run, f"id {kind}, ids binary").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """encoded with out_col: the text of its ids, special tokens included; bytes that are no UTF-8 become U+FFFD. Null ids: null."""
    schema = encoded.schema
    tune(encoded.sparkSession)
    at = schema.fieldNames().index(ids_col)

    def run(batches):
        own = vocabulary(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, own.decode_column(batch.column(at))], [*schema.fieldNames(), out_col])

    return map_batches(encoded, run, T.StructType([*schema.fields, T.StructField(out_col, T.StringType())]))
