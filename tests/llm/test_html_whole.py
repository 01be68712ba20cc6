"""op9: no text between surge and dive, beside an advert, after a '<' or in a layout wrapper is lost."""

from shelfcast.llm.html_text import main_text

LONG = "A long paragraph of the article that holds many words and reaches the highest peak of all. " * 6
AD = "<div class=ad>buy now</div>"


def test_short_runs_between_and_beside_are_kept():
    page = (f"<body><nav><a href=x>menu</a></nav><div class=post><h1>Title</h1>{AD}<p>{LONG}</p>{AD}<p>Short one.</p>{AD}"
            f"<p>{LONG}</p>{AD}<ul><li>The end.</ul></div>{AD}<div class=box>Weather</div><footer>f</footer></body>")
    assert main_text(page) == f"Title {LONG.strip()} Short one. {LONG.strip()} The end."


def test_less_than_sign_that_starts_no_tag():
    assert main_text("<p>if a < b then c, and 1 <2 holds") == "if a < b then c, and 1 <2 holds"
    assert main_text("no markup: a < b") == "no markup: a < b"
    assert main_text("<p>cut off in a tag <a href='x") == "cut off in a tag"


def test_layout_wrappers_are_not_emptied():
    for name in ("has-sidebar", "page no-sidebar", "page-header-fixed", "social-science", "news-alert"):
        for inner in (f"<article><p>{LONG}</article>", f"<p>{LONG}</p>"):
            page = f"<body><div class=ad>buy</div><div class='{name}'><div class=menu>m</div>{inner}<div id=comments>c</div></div><footer>f</footer>"
            assert main_text(page) == LONG.strip(), (name, inner)
    assert main_text(f"<body><form action=x><input name=v><nav><a href=y>n</a></nav><main><p>{LONG}</p></main></form>") == LONG.strip()
    assert main_text(f"<body><form action=x><div><p>{LONG}</p></div></form><footer>f</footer>") == LONG.strip()


def test_noise_that_is_longer_than_the_article_is_dropped():
    comments = f"<div id=comments><article class=comment><p>{LONG * 3}</article></div>"
    assert main_text(f"<body><article><p>{LONG}</article>{comments}") == LONG.strip()
    assert main_text(f"<body><div class=post><p>{LONG}</p></div><div id=comments><p>{LONG * 3}</p></div>") == LONG.strip()
    assert main_text(f"<body><div class=post><p>{LONG}</p></div><footer>{LONG * 3}</footer>") == LONG.strip()
    page = f"<body><div class=has-sidebar><article><p>{LONG}</article>{comments}</div>"
    assert main_text(page) == LONG.strip()
