"""Each operator against a brute-force version on a small fixture with nulls, empty texts, ties and repeats."""

import collections
import hashlib
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from shelfcast.llm import (bpe, exact_dedup, html_text, jaccard_join, language_id, lm_scoring, mixing, quality,
                           suffix_dedup, url_filter)
from shelfcast.llm.queries import VOCABULARY

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, id string"


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


@pytest.fixture(scope="module")
def texts():
    base = " ".join(f"word{i * 7 % 101} and thing{i}" for i in range(80)) + "."
    near = base.replace("thing40", "other")
    far = " ".join(f"x{i} y{i * i}" for i in range(90)) + "."
    return [base, near, base.upper(), far, None, "", "   ", "Two words", "two WORDS", far[:300] + " tail " + base[100:400], "é ß 你好 " * 30, "a" * 5000]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en" if i % 2 else "de", ["s1", "s2", None][i % 3], len(t or ""), "clash", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def test_jaccard_components(docs, texts):
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[k:k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set()))
    comp = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 90 * len(a | b):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    got = {r.doc_id: r for r in jaccard_join.jaccard_components(docs, width=3, percent=90).collect()}
    assert [got[i].component_id for i in range(len(texts))] == comp
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]


def test_lm_base_score(docs, texts):
    train = F.crc32(F.col("doc_id").cast("string")) % 7 != 2
    got = {r.doc_id: r for r in lm_scoring.score_documents(docs, train).collect()}
    toks = {i: words(t) + ["\0"] for i, t in enumerate(texts)}
    count = collections.Counter(w for i, t in toks.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in t)
    n, v = sum(count.values()), len(count)
    for i, t in toks.items():
        assert got[i].n_tokens == len(t) and got[i].train_tokens == n and got[i].n_known == sum(count[w] > 0 for w in t)
        assert got[i].base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t))
        assert got[i].score < 0


def test_mix_near_targets(spark):
    rows = [(i, "w " * (i % 40 + 1), ["a", "b", "c", None][i % 4 if i % 3 else 0]) for i in range(400)] + [(400, None, "b")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.words_taken(d).collect()
    again = mixing.words_taken(d).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == 401
    for s in ("a", "b", "c", None):
        own = [r for r in got if r.source == s]
        assert sum(r.taken for r in own) == pytest.approx(own[0].target, abs=130)
    assert all(r.taken <= 3 * r.size for r in got)
    assert sum({r.source: r.target for r in got}.values()) == pytest.approx(sum(r.size for r in got))


def test_bpe_round_trip(docs, texts):
    from tokenizers import Tokenizer
    path = VOCABULARY
    tok, own = Tokenizer.from_file(path), bpe.vocabulary(path)
    cases = [t or "" for t in texts] + ["a  b\n\n c\t<|endoftext|> d", "  x  ", "it's  <|endoftext|>", "don't\x1cstop 1²Ⅷ", "x" * 300]
    for t in cases:
        ids = tok.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids and own.encode_digits(t) == ",".join(map(str, ids))
        assert own.decode(ids) == tok.decode(ids, skip_special_tokens=False)
    got = {r.doc_id: r for r in bpe.encode_digests(docs, path).collect()}
    assert got[4].n_tokens == 0 and got[0].decoded_sha256 == hashlib.sha256(texts[0].encode()).hexdigest()


def test_url_verdicts(spark):
    urls = [None, "", "no scheme", "http://A.example.org/es/1?x", "https://m.example.org/en/12", "http://q.com/fr", "http://q.com/fr/casino",
            "http://free-bets.net/", "http://freebets.net/", "http://casino.net/x", "http://x.net/#casino"]
    got = url_filter.judge_urls(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")).orderBy("page_id").collect()
    assert [r.verdict for r in got] == ["allow", "allow", "allow", "block", "block", "allow", "allow", "block", "allow", "block", "block"]
    assert got[3].host == "a.example.org" and got[3].rule == "example.org/es/" and got[2].host == "" and got[5].path == "/fr"


def test_quality_rules(docs, texts):
    got = {r.doc_id: r for r in quality.quality_rules(docs).collect()}
    assert got[0].kept is True and got[3].kept is True and got[4].n_words == 0 and got[4].base_failed
    assert got[10].base_failed and got[10].n_repeat_words == 90
    assert quality.quality_rules(docs).filter("kept").count() == sum(r.kept for r in got.values())


def test_suffix_dedup(docs, texts):
    seen, got = set(), {r.doc_id: r for r in suffix_dedup.remove_repeats(docs).collect()}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            if b[k:k + 100] in seen:
                gone[k:k + 100] = b"\1" * 100
            seen.add(b[k:k + 100])
        kept = bytes(c for c, g in zip(b, gone) if not g)
        assert (got[i].n_removed, got[i].kept_sha256) == (sum(gone), hashlib.sha256(kept).hexdigest())


def test_loser_tree_merges():
    runs = [sorted(bytes([a, b, c, 9]) for c in range(3)) for a in (1, 2) for b in (1, 2)] + [[]]
    coded = [([0] + [suffix_dedup.common(x, y, 0) for x, y in zip(r, r[1:])], r) for r in runs]
    at, out = [0] * len(runs), []
    for r, _ in suffix_dedup.loser_tree(coded, 4):
        out.append(runs[r][at[r]])
        at[r] += 1
    assert out == sorted(x for r in runs for x in r)


def test_exact_groups(docs, texts):
    got = {r.doc_id: r for r in exact_dedup.exact_groups(docs, share=0.2).collect()}
    assert got[0].keep_id == got[2].keep_id == 2 and not got[0].kept and got[2].kept and got[4].keep_id == 5
    assert got[7].keep_id == 8 and got[3].group_size == 1
    kept = exact_dedup.drop_exact_copies(docs.union(docs))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 5, 6, 8, 9, 10, 11]


def test_main_text():
    page = ("<html><head><title>t</title></head><body><nav><a href=x>menu</a></nav><div class=ad>buy</div><article><h1>A &amp; B</h1>"
            "<p>One  two.<p><b>Three</b> four</article><div id=comments><p>reader</div><footer>f</footer>")
    assert html_text.main_text(page) == "A & B One two. Three four"
    assert html_text.main_text(None) == html_text.main_text("") == ""


def test_language_id(spark):
    en, de = "the house and the garden are old ", "das alte haus und der garten sind grün "
    rows = [(i, (en if i % 2 else de) * (i % 5 + 1), "en" if i % 2 else "de") for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(d)
    test = spark.createDataFrame([(1, "the old garden"), (2, "der garten"), (3, None), (4, "123 !"), (5, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in language_id.predict(test, model).collect()}
    assert [got[i].lang_pred for i in range(1, 6)] == ["en", "de", "und", "und", "und"]
    assert all(0 <= r.score <= 1 for r in got.values())


def test_no_rows(docs):
    none = docs.filter("false")
    assert exact_dedup.exact_groups(none).count() == 0 and suffix_dedup.remove_repeats(none).count() == 0
    assert quality.quality_rules(none).count() == 0 and mixing.words_taken(none).count() == 0
    assert lm_scoring.score_documents(none, F.lit(True)).count() == 0
    assert jaccard_join.jaccard_components(none).count() == 0
