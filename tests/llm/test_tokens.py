"""BPE against the tokenizers library; token counts against a plain dynamic program."""

import array
import base64
import hashlib
import math
import random

import public_tokenizers
import pytest
import regex
from tokenizers import Tokenizer as Library

from locusweave.llm import bpe, token_counts
from .conftest import rows_by_id

PATH = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = [*"abcXYZ 0123!?#$%&'…", "'s", "'T", "'LL", "Σ", "ΑΣ", "İ", "ß", "é", "é", "½", "\t", "\x1c", "\x85", "\xa0", " ", "　", "​", "漢", "한", "🙂", "<|endoftext|>", "<|startoftext|>", "<|end", "the ", "ing", "\u0000"]


@pytest.fixture(scope="module")
def both():
    with open(PATH, "rb") as file:
        return bpe.Vocabulary(file.read()), Library.from_file(PATH)


def test_same_ids_and_text_as_the_library(both):
    own, library = both
    rng = random.Random(3)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    texts += ["z" * 64, "z" * 65, "ab" * 400, "hello" * 50, "a" * 20_000, "漢" * 700]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert array.array("I", own.encode(text)).tolist() == ids
        assert own.decode(own.encode(text)) == library.decode(ids, skip_special_tokens=False)


def test_array_and_heap_agree(both):
    own, _ = both
    rng = random.Random(4)
    for _ in range(500):
        raw = "".join(rng.choice("ethsrinoa") for _ in range(rng.randint(1, 60))).encode()
        parts = [own.inner[b] for b in raw[:-1]] + [own.final[raw[-1]]]
        assert own._by_array(list(parts)) == own._by_heap(list(parts))


def test_digests_on_hard_rows(hard, empty, both):
    _, library = both
    texts = rows_by_id(hard.select("doc_id", "text"))
    found = rows_by_id(bpe.digests(hard, PATH))
    assert len(found) == len(texts)

    def expected(text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        return len(ids), hashlib.sha256(array.array("I", ids).tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    key = lambda r: (str(r[0]), *r[1:])
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in found), key=key) == sorted(((r["doc_id"], *expected(r["text"])) for r in texts), key=key)
    assert bpe.digests(empty, PATH).count() == 0


def test_columns_of_ids_and_text(spark, both):
    _, library = both
    docs = spark.createDataFrame([("Hello there, World",), (None,), ("",)], "text string")
    tool = bpe.Tokenizer(spark, PATH)
    rows = docs.select("text", tool.encode(docs.text).alias("ids")).select("text", "ids", tool.decode("ids").alias("back")).collect()
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert list(r.ids) == ids and r.back == library.decode(ids, skip_special_tokens=False)


def test_token_counts(hard, empty):
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file.read().splitlines() if line)}

    def plain(word):
        raw, best = word.encode(), [(0.0, 0)]
        for k in range(1, len(raw) + 1):
            options = [(best[j][0] - math.log(ranks[raw[j:k]] + 1), best[j][1] + 1) for j in range(max(0, k - 128), k) if raw[j:k] in ranks]
            top = max(o[0] for o in options)
            best.append((top, min(o[1] for o in options if o[0] == top)))
        return best[-1][1]

    memory = {}
    found = rows_by_id(token_counts.token_counts(hard, RANKS, public_tokenizers.PATTERN))
    texts = rows_by_id(hard.select("doc_id", "text"))
    want = []
    for r in texts:
        words = regex.findall(public_tokenizers.PATTERN, r["text"] or "")
        want.append((str(r["doc_id"]), len(words), sum(memory[w] if w in memory else memory.setdefault(w, plain(w)) for w in words)))
    assert sorted((str(r["doc_id"]), r["n_pretokens"], r["n_tokens"]) for r in found) == sorted(want)
    assert token_counts.token_counts(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_a_full_trie_starts_afresh(monkeypatch):
    with open(RANKS, "rb") as file:
        content = file.read()
    text = "many different words in one single sentence, and then they come again: many different words"
    whole = token_counts.Trie(content, public_tokenizers.PATTERN).text(text)
    monkeypatch.setattr(token_counts, "MOST_NODES", 20)
    assert token_counts.Trie(content, public_tokenizers.PATTERN).text(text) == whole
