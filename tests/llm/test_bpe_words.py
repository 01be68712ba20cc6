"""The shared arrays of BPE words: equal ids at any size of chunk and table, bounded memory, no Python work per merge."""
import cProfile
import pstats
import random
import tracemalloc

import pytest
from tokenizers import Tokenizer

from shelfcast.llm import bpe
from shelfcast.llm.queries import VOCABULARY


def distinct_words(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("aeiounrstlé") for _ in range(rng.randrange(6, 16))) + str(k) for k in range(n)]


@pytest.mark.parametrize("chunk,remember", [(1, 1), (40, 8), (1 << 18, 1 << 16)])
def test_chunks_and_forgotten_words_give_the_same_ids(monkeypatch, chunk, remember):
    monkeypatch.setattr(bpe, "CHUNK", chunk)
    monkeypatch.setattr(bpe, "REMEMBER", remember)
    library, vocab, rng = Tokenizer.from_file(VOCABULARY), bpe.Vocabulary(VOCABULARY), random.Random(5)
    library.no_truncation()
    library.no_padding()
    parts = ["the", " cat", "'s", "  ", "\n", " ", "\x1c", "\xa0", "éà", "日本", "12", "!?", "<|endoftext|>", "y" * 70, "Donau" * 30, "\U0001f600"]
    texts = ["", " ", *["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(300)], "", " ".join(distinct_words(200, 1)), ""]
    found = list(vocab.encode_all(texts))
    assert found == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [vocab.decode(ids) for ids in found] == [library.decode(ids, skip_special_tokens=False) for ids in found]


def test_a_worker_remembers_a_bounded_number_of_words():
    vocab = bpe.Vocabulary(VOCABULARY)
    words = distinct_words(300_000, 2)
    texts = [" ".join(w + "," for w in words[k:k + 500]) for k in range(0, len(words), 500)]
    tracemalloc.start()
    before = tracemalloc.get_traced_memory()[0]
    for text in texts:
        vocab.encode_digits(text)
    after = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert after - before < 24 << 20  # 65,536 words and those of one chunk


def test_new_words_cost_no_calls_per_merge():
    vocab, words = bpe.Vocabulary(VOCABULARY), distinct_words(20_000, 3)
    run = cProfile.Profile()
    run.runcall(vocab.encode_digits, " ".join(words))
    assert pstats.Stats(run).total_calls < 8 * len(words)
