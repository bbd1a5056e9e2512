"""Token counts of whole texts under a unigram model over a published vocabulary.

A text is cut into pre-tokens. The best segmentation of a pre-token into vocabulary entries is the one with
the largest sum of unigram scores; of equal sums, the one with fewer tokens. The score of the entry of rank r
is -log(r + 1): entries are listed by how early they were merged, and by Zipf's law frequency falls with rank.

Distinct pre-tokens go into a trie. The forward score of a node (best sum, and number of tokens, for the
letters down to it) depends on its prefix alone, so it is computed once when the node is made and shared by
every pre-token that passes it; the node where a pre-token ends stores its count.

Rows: null and empty texts count nothing; very long texts are counted whole; an empty table gives an empty
table. All 256 bytes are entries, so every text has a segmentation.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Nodes and remembered pre-tokens of a worker before it starts afresh; bounds memory, not results.
MOST_NODES = 400_000
MOST_WORDS = 150_000


class Trie:
    def __init__(self, file: bytes, pattern: str) -> None:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file.splitlines() if line.strip())}
        self.scores = {token: -math.log(rank + 1) for token, rank in ranks.items()}
        self.longest = max(map(len, self.scores))
        #: By an entry's last two bytes: the lengths that such entries have.
        self.lengths: dict[bytes, list[int]] = {}
        for token in self.scores:
            self.lengths.setdefault(token[-2:], []).append(len(token))
        self.lengths = {k: sorted(set(v)) for k, v in self.lengths.items()}
        self.split = regex.compile(pattern).findall
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.forward: list[tuple[float, int]] = [(0.0, 0)]
        self.terminal: dict[str, int] = {}

    def count(self, word: str) -> int:
        """Tokens of one pre-token; adds its missing nodes."""
        raw = word.encode("utf-8", "surrogatepass")
        if len(self.terminal) >= MOST_WORDS or len(self.forward) + len(raw) >= MOST_NODES:
            self.clear()
        child, forward, scores, lengths = self.child, self.forward, self.scores, self.lengths
        node, path = 0, [0]
        for k, letter in enumerate(raw, 1):
            step = node << 8 | letter
            node = child.get(step)
            if node is None:
                node = child[step] = len(forward)
                best, fewest = -math.inf, 0
                ends = raw[max(0, k - 2) : k]
                for size in (1, *lengths.get(ends, ())) if len(ends) == 2 else (1,):
                    if size > k:
                        break
                    if (own := scores.get(raw[k - size : k])) is not None:
                        sum_, n = forward[path[k - size]]
                        if sum_ + own > best or (sum_ + own == best and n + 1 < fewest):
                            best, fewest = sum_ + own, n + 1
                forward.append((best, fewest))
            path.append(node)
        n = forward[node][1]
        if len(raw) <= 64:
            self.terminal[word] = n
        return n

    def text(self, text: str | None) -> tuple[int, int]:
        """(pre-tokens, tokens) of a whole text."""
        total, pieces = 0, self.split(text or "")
        for word in pieces:
            n = self.terminal.get(word)
            total += self.count(word) if n is None else n
        return len(pieces), total


_TRIES: dict[str, Trie] = {}


class Counter:
    """A rank file, read once on the driver and broadcast (a MB, whatever the data)."""

    def __init__(self, spark: SparkSession, path: str, pattern: str) -> None:
        with open(path, "rb") as file:
            content = file.read()
        self._pattern = pattern
        self._key = hashlib.sha256(content + pattern.encode()).hexdigest()
        self._file = spark.sparkContext.broadcast(content)

    def trie(self) -> Trie:
        if self._key not in _TRIES:
            _TRIES[self._key] = Trie(self._file.value, self._pattern)
        return _TRIES[self._key]

    def counts(self, text: Column) -> Column:
        """struct(n_pretokens, n_tokens) of the whole text."""
        def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            own = self.trie()
            for part in parts:
                rows = [own.text(t.as_py()) for t in part]
                yield pa.StructArray.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], ["n_pretokens", "n_tokens"])

        return F.arrow_udf(run, "struct<n_pretokens:bigint,n_tokens:bigint>")(text.cast("string"))


def token_counts(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_pretokens, n_tokens), a row for each row of ``docs``."""
    tool = Counter(docs.sparkSession, path, pattern)
    return docs.select(F.col(doc_id).alias("doc_id"), tool.counts(F.col(text)).alias("_r")).select("doc_id", "_r.*")
