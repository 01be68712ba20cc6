"""Small sources, new letters, texts of marks, menus without a name: what the contracts say of them."""

import random
import time
import unicodedata

from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfcast.llm import bpe, language_id, mixing
from shelfcast.llm.html_text import main_text
from shelfcast.llm.queries import VOCABULARY

LONG = "A long paragraph of the article that holds many words and reaches the highest peak of all. " * 6


def test_small_sources_come_near_their_targets(spark):
    rows = [(i, "w " * 10, f"s{i:03d}", "clash", "clash") for i in range(300)] + [(1000, "big " * 60_000, None, "clash", "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __id string, __n string")
    got = mixing.words_taken(docs).collect()
    assert len(got) == 301
    for r in got:
        assert abs(r.taken - r.target) <= max(1.0, 0.01 * r.target), r
        assert r.taken <= 3 * r["size"]
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_repeated_rows_and_null_ids_mix(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (None, "d e", None), (None, None, "x"), (2, "", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.words_taken(docs)
    assert got.count() == 5
    assert got.filter("taken > 3 * size").count() == 0
    assert mixing.words_taken(docs.limit(0)).count() == 0


def test_bpe_equals_the_library_on_any_code_point():
    vocab, library = bpe.Vocabulary(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    library.no_truncation()
    library.no_padding()
    late = [chr(int(c, 16)) for r in bpe.LATE.split() for c in r.split("-")]
    rng = random.Random(3)
    texts = [f"x{c}y 1{c}2 {c}{c} a" for c in late]
    for _ in range(4000):
        pool = [chr(c) for c in (rng.randrange(0x110000) for _ in range(6)) if not 0xD800 <= c < 0xE000] + [rng.choice(late), " ", "a", "1", "\n"]
        texts.append("".join(rng.choice(pool) for _ in range(12)))
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert vocab.encode(text) == ids, text
        assert vocab.encode_digits(text) == ",".join(map(str, ids))
        assert vocab.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_of_a_very_long_text():
    text = "word " * 100_000 + "x" * 300_000 + "ნო" * 50_000
    vocab = bpe.Vocabulary(VOCABULARY)
    assert vocab.decode(vocab.encode(text)) == text


def test_marks_alone_are_no_language(spark):
    rows = [(i, "the quick brown fox" if i % 2 else "der schnelle braune Fuchs", "en" if i % 2 else "de", "c", "c") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, n string")
    marks = [(90, "́̀", None, "c", "c"), (91, " ́ 12", None, "c", "c"), (92, None, None, None, None), (93, "ét", None, "c", "c"),
             (94, "", None, "c", "c"), (94, "", None, "c", "c"), (95, "fox " * 250_000, None, "c", "c")]
    assert {unicodedata.category(c) for c in marks[0][1]} == {"Mn"}
    model = language_id.train(docs)
    got = language_id.predict(spark.createDataFrame(marks, docs.schema), model).collect()
    pred = {r.doc_id: r.lang_pred for r in got}
    assert len(got) == 7 and [pred[k] for k in (90, 91, 92, 94)] == ["und"] * 4
    assert pred[93] in ("de", "en") and pred[95] == "en"
    assert language_id.predict(docs.limit(0), model).count() == 0
    assert {r.lang_pred for r in language_id.predict(docs, language_id.train(docs.filter(F.lit(False)))).collect()} == {"und"}


def test_menus_and_short_boxes_without_a_name_are_no_article():
    menu = "<div>" + "<li><a href=x>Item of a menu</a>" * 30 + "</div>"
    boxes = "".join(f"<div>{t}</div>" for t in ("Home", "Log in", "Basket 0", "Terms"))
    body = f"<div class=c><h1>T</h1><p>{LONG}</p><p>See <a href=y>a link</a>.</p><p><a href=z>Only a link</a></p><p>{LONG}</p><p>End.</p></div>"
    text = f"T {LONG.strip()} See a link. Only a link {LONG.strip()} End."
    for page in (menu + boxes + body, body + boxes + menu, boxes + menu + body + menu + boxes):
        assert main_text(f"<body>{page}</body>") == text


def test_names_within_an_article():
    kept = "<p class='social-proof'>s</p><p id='tag-line'>t</p><section class='related-work'>r</section><div>short</div>"
    gone = "".join(f"<div class='{c}'>gone</div>" for c in (
        "ad", "ad-slot", "advert box", "share-buttons", "comments", "newsletter-signup", "related-posts", "cookie-notice"))
    assert main_text(f"<article><p>{LONG}</p>{kept}{gone}</article>") == f"{LONG.strip()} s t r short"


def test_broken_and_huge_pages_take_linear_time():
    start = time.time()
    for page in ("<a " * 100_000, "<div><span>" * 20_000 + "</i>" * 20_000, "<!" * 100_000, '<a x="' * 30_000,
                 "<b>" * 20_000 + "<li><div>" + "<b>" * 20_000 + "<li></li>" * 20_000, "<h1><b>x" * 20_000, f"<p>{LONG}</p>" * 3000):
        main_text(page)
    assert time.time() - start < 20
    assert main_text(None) == main_text("") == main_text("<p></p>") == ""


def test_tag_without_its_end():
    assert main_text("<p>one <b title='a > b < c'>two</b <p>three</p") == "one two three"
    assert main_text("<p>it's <i lang=en>so</i>, isn't it?</p>") == "it's so, isn't it?"
