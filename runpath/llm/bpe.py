"""Byte-level BPE encoding and decoding with a given vocabulary, by a prefix-sharing trie traversal.

Texts are cut at the vocabulary's added tokens, and between them into words by the
pattern of byte-level pre-tokenizers.  The distinct words of some texts make a trie of
bytes, held in depth-first order (sorted, each word adding the nodes beyond what it
shares with the one before), which is walked once.  At each node the last token of the encoding of
the bytes so far is found from the states of the nodes above it: it is the one token
that ends there, and either is the whole prefix or fits the last token of the prefix
before it.  Two tokens fit when merging their bytes by rank leaves just these two.  So a
prefix that several words share is encoded once, and the tokens of a word are read off
its path backwards.  A task keeps the words it has met (``max_words`` at most).

Encoding needs no shuffle: each task reads its own texts.  The vocabulary, at most
``max_tokens`` tokens, is read by the driver and broadcast.

Defined results: a null or empty text has no tokens and decodes to an empty text (a
null list of ids to null); texts and words of any length are encoded whole; repeated
rows each get their ids; an empty table gives no rows; columns besides the one written pass through,
whatever their names.  Bytes that are no UTF-8 count as U+FFFD; ids that the vocabulary
doesn't have decode to nothing.
"""

from __future__ import annotations

import gc
import json
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runpath.llm import kernel
from runpath.llm.storage import small_batches


@dataclass(frozen=True)
class BpeParams:
    path: str = "/opt/tokenizers/byte_bpe_50k.json"
    #: Distinct words that a task keeps with their tokens.
    max_words: int = 300_000
    #: Texts, and bytes of them, whose words are put into one trie.
    chunk_rows: int = 512
    chunk_bytes: int = 4 << 20
    max_tokens: int = 1 << 20


PARAMS = BpeParams()

# The pattern of byte-level pre-tokenizers.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Code points whose classes (letter, number, space) every version of Unicode tables in use agrees on.  A text with any other is cut by the tokenizers library, whose tables count.
OTHER = regex.compile(r"[^\x00-ɏͰ-ͷΆ-ϿЀ-ԯא-תء-ي٠-٩अ-ह०-९Ḁ-ỿ‐-‧‰-⁞₠-€←-⇿、-〃ぁ-ゖァ-ヺ一-龥가-힣！-～\U0001F600-\U0001F64F]")


def byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves, and the others as the code points from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@dataclass(frozen=True)
class Vocabulary:
    """tokens: bytes of each id; merges: (left, right, made) ids in order of rank; added: content -> id of tokens cut out of texts first."""

    tokens: list[bytes | None]
    merges: list[tuple[int, int, int]]
    added: dict[str, int]


def read_vocabulary(path: str, max_tokens: int = PARAMS.max_tokens) -> Vocabulary:
    """A byte-level BPE vocabulary from a tokenizers JSON file; other kinds are an error."""
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    model, pre = raw["model"], raw["pre_tokenizer"] or {}
    if raw.get("normalizer") or model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model.get("dropout") or model.get("ignore_merges"):
        raise ValueError(f"{path} is no plain byte-level BPE vocabulary")
    if any(a["normalized"] or a["lstrip"] or a["rstrip"] or a["single_word"] for a in raw["added_tokens"]):
        raise ValueError(f"{path} has added tokens that take more than their own text")
    added = {a["content"]: a["id"] for a in raw["added_tokens"]}
    size = max([*model["vocab"].values(), *added.values()]) + 1
    if size > max_tokens:
        raise ValueError(f"{path} has {size} ids, more than {max_tokens}")
    chars, tokens = byte_of_char(), [None] * size
    for text, i in model["vocab"].items():
        tokens[i] = bytes(chars[c] for c in text)
    ids, merges = model["vocab"], []
    for m in model["merges"]:
        a, b = m.split(" ") if isinstance(m, str) else m
        merges.append((ids[a], ids[b], ids[a + b]))
    made = {m for *_, m in merges}
    if len(made) != len(merges) or any(len(tokens[i]) != 1 for i in ids.values() if i not in made):
        raise ValueError(f"{path} makes some token by two merges or by none")
    for content, i in added.items():
        tokens[i] = content.encode()
    return Vocabulary(tokens, merges, added)


def shared_bytes(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return n - (differ.bit_length() + 7) // 8


class Encoder:
    """Last-token states over a vocabulary."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.length = [len(t or b"") for t in v.tokens]
        self.rank = {(a, b): r for r, (a, b, _) in enumerate(v.merges)}
        self.halves = {made: (a, b, r) for r, (a, b, made) in enumerate(v.merges)}
        self.own: dict[int, bool] = {}
        # Tokens read backwards, byte by byte; -1 leads to the token that a node is.
        self.back: dict = {}
        for i, t in enumerate(v.tokens):
            if t and (i in self.halves or len(t) == 1) and self.is_own(i):
                node = self.back
                for byte in reversed(t):
                    node = node.setdefault(byte, {})
                node[-1] = i
        self.fitting: dict[tuple[int, int], bool] = {}
        bounds = [regex.escape(c) for c in sorted(v.added, key=len, reverse=True)]
        self.added = regex.compile(f"({'|'.join(bounds)})") if bounds else None
        self.pattern, self.library = regex.compile(WORDS), None

    def edge(self, token: int, side: int) -> Iterator[tuple[int, int]]:
        """(piece, rank of the merge that takes it in) of the pieces that stand at one end of a token while it is made, the token itself first."""
        until = len(self.v.merges)
        while True:
            yield token, until
            half = self.halves.get(token)
            if half is None:
                return
            token, until = half[side], half[2]

    def crossed(self, a: int, b: int, before: int) -> bool:
        """Does a merge of rank under `before` join pieces of a and b while the bytes of a followed by those of b are merged?"""
        right = list(self.edge(a, 1))
        for y, until_y in self.edge(b, 0):
            for x, until_x in right:
                r = self.rank.get((x, y))
                # Of equal pairs the one further to the left goes first.
                if r is not None and r < before and r < until_x and r <= until_y:
                    return True
        return False

    def is_own(self, token: int) -> bool:
        """Are the bytes of a token encoded as that token?"""
        known = self.own.get(token)
        if known is None:
            half = self.halves.get(token)
            known = self.own[token] = half is None or (self.is_own(half[0]) and self.is_own(half[1]) and not self.crossed(half[0], half[1], half[2]))
        return known

    def fits(self, a: int, b: int) -> bool:
        """Are the bytes of two tokens encoded as these two?"""
        if len(self.fitting) > 2_000_000:
            self.fitting.clear()
        known = self.fitting[a, b] = not self.crossed(a, b, len(self.v.merges))
        return known

    def last_token(self, path: bytearray | bytes, last: list[int], end: int) -> int:
        """The last token of the encoding of path[:end], given those of all shorter prefixes."""
        node, start, found = self.back, end, []
        while start:
            node = node.get(path[start - 1])
            if node is None:
                break
            start -= 1
            if -1 in node:
                found.append((start, node[-1]))
        fitting = self.fitting.get
        for start, token in reversed(found):
            if not start:
                return token
            pair = last[start], token
            known = fitting(pair)
            if known or (known is None and self.fits(*pair)):
                return token
        raise ValueError("a byte has no token")

    def tokens_of(self, last: list[int], end: int) -> list[int]:
        out = []
        while end:
            out.append(last[end])
            end -= self.length[last[end]]
        return out[::-1]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Tokens of distinct words in ascending order, by one walk over their trie.

        The trie lies in depth-first order: its nodes are the prefixes of the words, and word after word adds the nodes
        beyond the bytes that it shares with the one before.  The walk backs up to the last shared node and goes on from
        the states that are held for the path to it.
        """
        out, before, last = [], b"", [-1]
        for word in words:
            del last[shared_bytes(before, word) + 1 :]
            for end in range(len(last), len(word) + 1):
                last.append(self.last_token(word, last, end))
            out.append(self.tokens_of(last, len(word)))
            before = word
        return out

    def cut(self, text: str) -> list[str]:
        """The added tokens and words of a text; no word can be the text of an added token."""
        parts = self.added.split(text) if self.added else [text]
        out = []
        for i, part in enumerate(parts):
            if i % 2:
                out.append(part)
            elif OTHER.search(part):
                if self.library is None:
                    from tokenizers import pre_tokenizers

                    self.library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
                out += [part[a:b] for _, (a, b) in self.library.pre_tokenize_str(part)]
            else:
                out += self.pattern.findall(part)
        return out


_encoders: dict[str, Encoder] = {}


def _encoder(path: str, shared) -> Encoder:
    """One encoder for each Python worker: tasks that follow one another use it again."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(shared.value)
        gc.freeze()  # its tables stay as they are
    return _encoders[path]


class Words:
    """Words met by a task, and their tokens back to back."""

    def __init__(self, p: BpeParams):
        self.p = p
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.ids = [np.zeros(0, np.int32)]
        self.ends = [np.zeros(1, np.int64)]
        self.total = 0

    def learn(self, e: Encoder, met: set[str]) -> None:
        new = [*(met - self.number.keys())]
        if self.number and len(self.number) + len(new) > self.p.max_words:
            self.clear()
            new = [*met]
        pairs = sorted((w.encode(), w) for w in new if w not in e.v.added)
        plain = [w for _, w in pairs]
        tokens = e.encode_words([raw for raw, _ in pairs])
        for w in met & e.v.added.keys() - self.number.keys():
            plain.append(w)
            tokens.append([e.v.added[w]])
        self.number |= {w: len(self.number) + i for i, w in enumerate(plain)}
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.ids.append(np.fromiter(chain.from_iterable(tokens), np.int32, int(sizes.sum())))
        self.ends.append(self.total + np.cumsum(sizes))
        self.total += int(sizes.sum())

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        self.ids, self.ends = [np.concatenate(self.ids)], [np.concatenate(self.ends)]
        return self.ids[0], self.ends[0]


def gather(flat: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces number `at` of flat (piece i is flat[ends[i]:ends[i + 1]]) back to back, and where each begins (with the end)."""
    sizes = ends[at + 1] - ends[at]
    to = np.concatenate([[0], np.cumsum(sizes)])
    return flat[np.repeat(ends[at] - to[:-1], sizes) + np.arange(to[-1])], to


def encode_texts(e: Encoder, known: Words, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts back to back, and where each text begins (with the end)."""
    words = [e.cut(t) for t in texts]
    known.learn(e, set(chain.from_iterable(words)))
    first = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    at = np.fromiter(map(known.number.__getitem__, chain.from_iterable(words)), np.int64, int(first[-1]))
    ids, to = gather(*known.tables(), at)
    return ids, to[first]


def encoded(text: Column, spark: SparkSession, p: BpeParams = PARAMS) -> Column:
    """array<int>: the ids of a text column."""
    shared = spark.sparkContext.broadcast(read_vocabulary(p.path, p.max_tokens))

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        e, known = _encoder(p.path, shared), Words(p)
        for column in columns:
            parts = [pa.array([], pa.list_(pa.int32()))]
            for b in kernel.chunks(iter([pa.RecordBatch.from_arrays([column], names=["text"])]), p.chunk_rows, p.chunk_bytes):
                flat, off = encode_texts(e, known, [(t or b"").decode("utf-8", "replace") for t in b.column("text").to_pylist()])
                parts.append(pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(flat, pa.int32())))
            yield pa.concat_arrays(parts)
        kernel.trim()

    return ids(text.cast("binary"))


def decoded(ids: Column, spark: SparkSession, p: BpeParams = PARAMS) -> Column:
    """The text of a column of ids."""
    shared = spark.sparkContext.broadcast(read_vocabulary(p.path, p.max_tokens).tokens)

    @F.arrow_udf(T.StringType())
    def text(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = [*(t or b"" for t in shared.value), b""]  # the last one stands for ids that are not there
        flat, ends = np.frombuffer(b"".join(tokens), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
        for column in columns:
            out: list[str | None] = []
            for lo in range(0, len(column), p.chunk_rows):
                part = column.slice(lo, p.chunk_rows)
                lists = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                at = part.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                data, to = gather(flat, ends, np.where((at < 0) | (at >= len(tokens)), len(tokens) - 1, at))
                cut, raw = to[np.concatenate([[0], np.cumsum(lists)])].tolist(), data.tobytes()
                out += [raw[a:b].decode("utf-8", "replace") if there else None for a, b, there in zip(cut, cut[1:], part.is_valid().to_pylist(), strict=False)]
            yield pa.array(out, pa.string())
        kernel.trim()

    return text(ids)


def encode(documents: DataFrame, p: BpeParams = PARAMS, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """documents and the ids of each text in ids_col."""
    small_batches(documents.sparkSession)
    return documents.withColumn(ids_col, encoded(F.col(f"`{text_col}`"), documents.sparkSession, p))


def decode(rows: DataFrame, p: BpeParams = PARAMS, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """rows and the text of each list of ids in text_col."""
    small_batches(rows.sparkSession)
    return rows.withColumn(text_col, decoded(F.col(f"`{ids_col}`"), rows.sparkSession, p))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    both = decode(encode(docs).drop("text"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256")
    )
