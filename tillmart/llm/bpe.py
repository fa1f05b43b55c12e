"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

The vocabulary file stays where it is; its path is a parameter and each Python worker reads it
once. A text is cut at special tokens, then into pieces at white space, then by the split
pattern of byte-level vocabularies. Inside a word the tree's root names the leftmost pair of
lowest rank; a merge changes three leaves, each in logarithmic time, so one word of any length
costs n log n. Trees of words of like length are kept in the columns of one array and take their
steps together.
"""

import hashlib
import json
import re
import sys
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillmart.llm.common import ready_workers

#: Characters of text taken at a time, cut before white space, so that a very long text needs bounded memory.
CHUNK_CHARS = 1 << 20
#: Pieces remembered by a worker, and the most characters of one (250,000 pieces of 48 characters take some 100 MB);
#: the longest words merged side by side, and the leaves of their trees in all.
REMEMBERED, REMEMBERED_CHARS, SIDE_BY_SIDE, TREE_CELLS = 250_000, 48, 64, 1 << 18
NEVER = np.int64(1 << 62)

#: Fixed value: white space as byte-level split patterns know it (Unicode White_Space).
_SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _class_of(prefix: str) -> str:
    """The inside of a character class of all code points whose category starts with prefix."""
    runs, start = [], None
    for point in range(sys.maxunicode + 2):
        inside = point <= sys.maxunicode and unicodedata.category(chr(point)).startswith(prefix)
        if inside and start is None:
            start = point
        elif not inside and start is not None:
            runs.append(f"\\U{start:08x}-\\U{point - 1:08x}")
            start = None
    return "".join(runs)


@lru_cache(1)
def _patterns() -> tuple[re.Pattern, re.Pattern]:
    """Pieces between white space, and the tokens inside a piece; a white-space run leaves its last space to what follows."""
    letter, digit = _class_of("L"), _class_of("N")
    pieces = re.compile(rf" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
    words = re.compile(
        rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{digit}]+| ?[^{_SPACE}{letter}{digit}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
    )
    return pieces, words


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files, back to its byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [byte for byte in range(256) if byte not in set(shown)]
    return {chr(byte): byte for byte in shown} | {chr(256 + n): byte for n, byte in enumerate(hidden)}


class Vocabulary:
    """Ranks of pairs and bytes of ids, read from a tokenizer file of the byte-level kind."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model, letters = content["model"], _byte_letters()
        ids = model["vocab"]
        self.byte_ids = np.zeros(256, np.int64)
        for letter, byte in letters.items():
            self.byte_ids[byte] = ids[letter]
        pairs = [pair.split(" ") if isinstance(pair, str) else pair for pair in model["merges"]]
        self.merged = np.array([ids[left + right] for left, right in pairs], np.int64)
        self.width = max(ids.values()) + 1
        codes = np.array([ids[left] * self.width + ids[right] for left, right in pairs], np.int64)
        self.pair_codes, self.pair_ranks = np.unique(codes, return_index=True)
        self.rank_of = dict(zip(self.pair_codes.tolist(), self.pair_ranks.tolist()))
        self.bytes_of = {number: bytes(letters[letter] for letter in token) for token, number in ids.items()}
        self.special = {entry["content"]: entry["id"] for entry in content.get("added_tokens", ())}
        self.bytes_of |= {number: token.encode() for token, number in self.special.items()}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if longest_first else None
        self.known: dict[str, bytes] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NEVER for one that does not merge; a missing neighbour is -1."""
        codes = left * np.int64(self.width) + right
        codes[(left < 0) | (right < 0)] = -1
        place = np.minimum(np.searchsorted(self.pair_codes, codes), len(self.pair_codes) - 1)
        return np.where(self.pair_codes[place] == codes, self.pair_ranks[place], NEVER)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word. Words of like length are merged side by side, one tree per column."""
        out: list[bytes] = [b""] * len(words)
        by_size = defaultdict(list)
        for n, word in enumerate(words):
            by_size[max(2, 1 << (len(word) - 1).bit_length())].append(n)
        for size, places in by_size.items():
            if size > SIDE_BY_SIDE:
                for n in places:
                    out[n] = self._merge_alone(words[n])
                continue
            step = TREE_CELLS // size
            for start in range(0, len(places), step):
                some = places[start : start + step]
                for n, ids in zip(some, self._merge_alike([words[n] for n in some], size)):
                    out[n] = ids
        return out

    def _merge_alone(self, word: bytes) -> bytes:
        """The same tree for one long word; too few words are as long for columns to pay."""
        symbols = [*self.byte_ids[np.frombuffer(word, np.uint8)].tolist(), -1]
        count = len(word)
        size = 1 << (count - 1).bit_length()
        never, rank_of, width = int(NEVER), self.rank_of, self.width

        def key(i: int, right: int) -> int:
            rank = rank_of.get(symbols[i] * width + symbols[right]) if symbols[right] >= 0 else None
            return never if rank is None else rank * size + i

        tree = [never] * size + [key(i, i + 1) for i in range(count)] + [never] * (size - count)
        for node in range(size - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(leaf: int, value: int) -> None:
            node = size + leaf
            tree[node] = value
            while node > 1:
                node >>= 1
                least = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == least:
                    break
                tree[node] = least

        after, before = list(range(1, count + 2)), list(range(-1, count))
        while (root := tree[1]) != never:
            i = root % size
            j = after[i]
            symbols[i], symbols[j] = int(self.merged[root // size]), -1
            k = after[i] = after[j]
            before[k] = i
            put(j, never)
            put(i, key(i, k))
            if before[i] >= 0:
                put(before[i], key(before[i], i))
        return np.array([symbol for symbol in symbols if symbol >= 0], "<u4").tobytes()

    def _merge_alike(self, words: list[bytes], size: int) -> Iterator[bytes]:
        """Leaf i of a tree holds rank * size + i of the pair that starts at i, so its root is the leftmost of the lowest rank."""
        count = len(words)
        flat = np.frombuffer(b"".join(word.ljust(size, b"\0") for word in words), np.uint8).reshape(count, size)
        lengths = np.array([len(word) for word in words])
        symbols = np.full((size + 1, count), -1, np.int64)  # the last row is what follows the end
        symbols[:size] = np.where(np.arange(size) < lengths[:, None], self.byte_ids[flat], -1).T
        after = np.repeat(np.arange(1, size + 2), count).reshape(size + 1, count)
        before = after - 2
        tree = np.full((2 * size, count), NEVER)
        ranks = self.ranks(symbols[:-1], symbols[1:])
        tree[size:] = np.where(ranks == NEVER, NEVER, ranks * size + np.arange(size)[:, None])
        low = size
        while low > 1:
            tree[low // 2 : low] = np.minimum(tree[low : 2 * low : 2], tree[low + 1 : 2 * low : 2])
            low //= 2

        def put(leaf: np.ndarray, ranks: np.ndarray | None, word: np.ndarray) -> None:
            node = leaf + size
            tree[node, word] = NEVER if ranks is None else np.where(ranks == NEVER, NEVER, ranks * size + leaf)

        def lift(leaf: np.ndarray, word: np.ndarray) -> None:
            node = (leaf + size) >> 1
            while node[0]:  # all leaves are equally deep
                tree[node, word] = np.minimum(tree[2 * node, word], tree[2 * node + 1, word])
                node >>= 1

        word = np.arange(count)
        while True:
            root = tree[1, word]
            open_ = root != NEVER
            root, word = root[open_], word[open_]
            if not len(word):
                break
            i, rank = root % size, root // size
            j = after[i, word]
            symbols[i, word], symbols[j, word] = self.merged[rank], -1
            k = after[j, word]
            after[i, word] = k
            before[k, word] = i
            put(j, None, word)
            put(i, self.ranks(symbols[i, word], symbols[k, word]), word)
            h = before[i, word]
            has = h >= 0
            h, owner = h[has], word[has]
            if len(h):
                put(h, self.ranks(symbols[h, owner], symbols[i[has], owner]), owner)
                lift(h, owner)
            lift(j, word)
            lift(i, word)

        kept = symbols[:size].T
        mask = kept >= 0
        data, ends = kept[mask].astype("<u4").tobytes(), (np.cumsum(mask.sum(1)) * 4).tolist()
        start = 0
        for end in ends:
            yield data[start:end]
            start = end

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        return [b"".join(self._encoded(text)) for text in texts] if sum(map(len, texts)) > CHUNK_CHARS else self._encode_together(texts)

    def _encoded(self, text: str) -> Iterator[bytes]:
        for chunk in chunks(text, CHUNK_CHARS):
            yield from self._encode_together([chunk])

    def _encode_together(self, texts: list[str]) -> list[bytes]:
        """Texts of bounded size in all: the pieces not met before are merged at once."""
        find = _patterns()[0].findall
        cut = [self.cut.split(text) if self.cut else [text] for text in texts]
        pieces = [[[self.special[part]] if n % 2 else find(part) for n, part in enumerate(parts)] for parts in cut]
        met = set()
        for parts in pieces:
            for n, part in enumerate(parts):
                if not n % 2:
                    met.update(part)
        new = self._new(met)
        if new:
            self.known.update(new)
        recall = self.known.__getitem__
        coded = [
            b"".join([part[0].to_bytes(4, "little") if n % 2 else b"".join(map(recall, part)) for n, part in enumerate(parts)]) for parts in pieces
        ]
        for piece in new:
            if len(piece) > REMEMBERED_CHARS:
                del self.known[piece]
        while len(self.known) > REMEMBERED:
            for old in [old for _, old in zip(range(REMEMBERED // 2), self.known)]:
                del self.known[old]
        return coded

    def _new(self, met: set[str]) -> dict[str, bytes]:
        """The ids of pieces that are not remembered; equal words in them are merged once."""
        find, known = _patterns()[1].findall, self.known
        split = {piece: find(piece) for piece in met if piece not in known}
        words = list({word for found in split.values() for word in found})
        ids = dict(zip(words, self.merge([word.encode() for word in words])))
        return {piece: b"".join([ids[word] for word in found]) for piece, found in split.items()}

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


def chunks(text: str, size: int) -> Iterator[str]:
    """Cuts before a white-space run after a visible character; no piece crosses such a place."""
    start, length = 0, len(text)
    if length <= size:
        yield text
        return
    edge = re.compile(rf"(?<=[^{_SPACE}])(?=[{_SPACE}])")
    while start < length:
        found = edge.search(text, start + size) if start + size < length else None
        end = found.start() if found else length
        yield text[start:end]
        start = end


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_decode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, ids (little-endian unsigned 32-bit integers), n_tokens, decoded.

    A null or empty text has no ids and decodes to ''. Special tokens written in a text are that
    one id. An empty table gives an empty result; repeated rows are encoded each; other columns
    play no part. Nothing is shuffled, and a batch holds the texts of Arrow's batch size at most.
    """
    return _mapped(docs, vocabulary_path, id_col, text_col, False)


def encode_decode_digests(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode_decode, but with the SHA-256 of ids and of the decoded text in their place."""
    return _mapped(docs, vocabulary_path, id_col, text_col, True)


def _portions(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Rows in order, some megabytes of text or one text at a time."""
    lengths = [len(entry.as_buffer() or b"") if entry.is_valid else 0 for entry in batch.column(1)]
    start, held = 0, 0
    for n, length in enumerate([*lengths, 0]):
        if n == batch.num_rows or (held and held + length > CHUNK_CHARS):
            if n > start:
                some = batch.slice(start, n - start)
                yield some, [text or "" for text in some.column(1).to_pylist()]
            start, held = n, 0
        held += length


def _mapped(docs: DataFrame, vocabulary_path: str, id_col: str, text_col: str, digests: bool) -> DataFrame:
    ready_workers(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kinds = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "n_tokens long, ids binary, decoded string"
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(vocabulary_path)
        for batch in batches:
            for some, texts in _portions(batch):
                codes = words.encode(texts)
                counts = [len(ids) // 4 for ids in codes]
                texts = [words.decode(np.frombuffer(ids, "<u4")) for ids in codes]
                if digests:
                    codes = [hashlib.sha256(ids).hexdigest() for ids in codes]
                    texts = [hashlib.sha256(text.encode()).hexdigest() for text in texts]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["id", "n_tokens", "ids", "decoded"]
                kind = pa.string() if digests else pa.binary()
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(counts, pa.int64()), pa.array(codes, kind), pa.array(texts, pa.string())], names)

    return rows.mapInArrow(run, f"id {id_type}, {kinds}").withColumnRenamed("id", id_col)
