"""BPE encoding and decoding with a published word-end vocabulary.

Each distinct word of a worker is merged once. A short word is a contiguous array of parts with the merge
rank of each adjacent pair beside it: scan for the least rank, delete that boundary, refresh the two
neighbouring ranks. A long word takes a heap over the same ranks, so that one huge word is not quadratic.

Rows: null text is an empty text (no ids, empty decoded text); whole texts are encoded; an id that the
vocabulary lacks decodes to nothing; an empty table gives an empty table. Other columns are left alone.
"""

from __future__ import annotations

import array
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Symbols up to which a word is merged in the rank array.
SHORT_WORD = 64
#: Words that a worker remembers before it starts afresh.
REMEMBERED = 200_000
_NONE = 1 << 60

# Fixed values of the vocabulary's own settings: white space, the split pattern, the end-of-word mark.
_SPACES = regex.compile(r"[\t-\r \x85\xa0  -     　]+")
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^ \p{L}\p{N}]+")
_END = "</w>"


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: printable Latin-1 stays, the others follow from U+0100."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(others)) for b in range(256)]


class Vocabulary:
    """Merge ranks and tokens, from the bytes of a tokenizer file."""

    def __init__(self, file: bytes) -> None:
        raw = json.loads(file)
        ids = raw["model"]["vocab"]
        self.tokens = {i: t for t, i in ids.items()} | {t["id"]: t["content"] for t in raw["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in raw["added_tokens"]}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pairs, self.merged = {}, []
        for rank, (left, right) in enumerate(m.split(" ") if isinstance(m, str) else m for m in raw["model"]["merges"]):
            self.pairs[ids[left] << 32 | ids[right]] = rank
            self.merged.append(ids[left + right])
        letters = byte_letters()
        self.inner = [ids[c] for c in letters]
        self.final = [ids[c + _END] for c in letters]
        self.known: dict[str, bytes] = {}

    def merge(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "surrogatepass")
        parts = [self.inner[b] for b in raw[:-1]] + [self.final[raw[-1]]]
        return self._by_array(parts) if len(parts) <= SHORT_WORD else self._by_heap(parts)

    def _by_array(self, parts: list[int]) -> list[int]:
        rank = self.pairs.get
        ranks = [rank(a << 32 | b, _NONE) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == _NONE:
                break
            k = ranks.index(least)
            parts[k] = self.merged[least]
            del parts[k + 1], ranks[k]
            if k < len(ranks):
                ranks[k] = rank(parts[k] << 32 | parts[k + 1], _NONE)
            if k:
                ranks[k - 1] = rank(parts[k - 1] << 32 | parts[k], _NONE)
        return parts

    def _by_heap(self, parts: list[int]) -> list[int]:
        n, rank = len(parts), self.pairs.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k, parts[k], parts[k + 1]) for k in range(n - 1) if (r := rank(parts[k] << 32 | parts[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, k, left, right = heapq.heappop(heap)
            j = after[k]
            if parts[k] != left or j >= n or parts[j] != right:
                continue
            parts[k], parts[j] = self.merged[r], -1
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
            for x in (before[k], k):
                if x >= 0 and after[x] < n and (s := rank(parts[x] << 32 | parts[after[x]])) is not None:
                    heapq.heappush(heap, (s, x, parts[x], parts[after[x]]))
        return [p for p in parts if p >= 0]

    def encode(self, text: str | None) -> bytes:
        """The ids, each as four little-endian bytes."""
        if not text:
            return b""
        out, known = [], self.known
        for k, piece in enumerate(self.special_split.split(text) if self.special_split else [text]):
            if k % 2:
                out.append(self.special[piece].to_bytes(4, "little"))
                continue
            piece = _SPACES.sub(" ", unicodedata.normalize("NFC", piece))
            # Letter by letter, so a capital sigma has one small form wherever it stands.
            for word in _SPLIT.findall(piece.replace("Σ", "σ").lower()):
                ids = known.get(word)
                if ids is None:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    ids = array.array("I", self.merge(word)).tobytes()
                    if len(word) <= SHORT_WORD:
                        known[word] = ids
                out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes | None) -> str:
        """Tokens with a space between them; special tokens are kept."""
        token = self.tokens.get
        return " ".join([t for i in array.array("I", ids or b"") if (t := token(i)) is not None])


_VOCABULARIES: dict[str, Vocabulary] = {}


class Tokenizer:
    """A tokenizer file, read once on the driver and broadcast (a few MB, whatever the data)."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        with open(path, "rb") as file:
            content = file.read()
        self._key = hashlib.sha256(content).hexdigest()
        self._file = spark.sparkContext.broadcast(content)

    def vocabulary(self) -> Vocabulary:
        if self._key not in _VOCABULARIES:
            _VOCABULARIES[self._key] = Vocabulary(self._file.value)
        return _VOCABULARIES[self._key]

    def encode(self, text: Column) -> Column:
        """array<int> of the whole text."""
        def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            own = self.vocabulary()
            for part in parts:
                yield pa.array([array.array("I", own.encode(t.as_py())).tolist() for t in part], pa.list_(pa.int32()))

        return F.arrow_udf(run, "array<int>")(text.cast("string"))

    def decode(self, ids: Column) -> Column:
        """Text of an array<int>; a null array or element gives nothing."""
        def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            own = self.vocabulary()
            for part in parts:
                yield pa.array([own.decode(array.array("I", [i for i in x.as_py() or () if i is not None and i >= 0]).tobytes()) for x in part], pa.string())

        return F.arrow_udf(run, "string")(ids)

    def round_trip(self, text: Column) -> Column:
        """struct(n_tokens, ids_sha256, decoded_sha256): encode, then decode those ids; only digests leave the worker."""
        def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            own = self.vocabulary()
            for part in parts:
                rows = []
                for t in part:
                    ids = own.encode(t.as_py())
                    rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(own.decode(ids).encode("utf-8", "surrogatepass")).hexdigest()))
                n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

        return F.arrow_udf(run, "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>")(text.cast("string"))


def digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), a row for each row of ``docs``."""
    tool = Tokenizer(docs.sparkSession, path)
    return docs.select(F.col(doc_id).alias("doc_id"), tool.round_trip(F.col(text)).alias("_r")).select("doc_id", "_r.*")
