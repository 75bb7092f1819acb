"""Surge and dive points choose the text of a page."""

import pytest

from granary.llm import html_text

LONG = "A paragraph of the page that is long enough to make any window over it rise well above what stands around it."


def blocks(*texts, tag="div"):
    return "".join(f"<{tag}>{t}</{tag}>" for t in texts)


def test_unmarked_boilerplate_goes():
    page = blocks("My Site", "Call us 555-1234 today", LONG * 4, "All rights reserved 2020")
    assert html_text.main_text(page) == LONG * 4
    page = blocks("My Site") + "<h2>Head</h2>" + blocks(LONG * 4, "Short one.", LONG, "By us.")
    assert html_text.main_text(page) == f"Head {LONG * 4} Short one. {LONG}"
    assert html_text.main_text(blocks("All", "lines", "are", "short")) == "All lines are short"


@pytest.mark.parametrize("name", ["side-by-side", "related-work", "search-results", "legal text"])
def test_doubtful_classes_weigh_down_only(name):
    body = f"<h1>Head</h1><p>{LONG}</p><p>{LONG}</p>"
    assert html_text.main_text(f"<article><div class='{name}'>{body}</div></article>") == f"Head {LONG} {LONG}"
    assert html_text.main_text(f"<article><p>{LONG * 9}</p><div class='{name}'>{body}</div></article>") == f"{LONG * 9} Head {LONG} {LONG}"
    assert html_text.main_text(f"<article>{body * 9}<div class='{name}'>Look here, too</div></article>").endswith(LONG)


def test_long_and_short_lines_of_an_article_stay():
    short = ["So.", "On.", "It.", "Is.", "Up.", "No."]
    page = f"<article>{blocks(*short, tag='p')}{blocks(*[LONG] * 8, 'word ' * 100_000, tag='p')}{blocks(*short, tag='p')}</article>"
    assert html_text.main_text(page) == " ".join([*short, *[LONG] * 8, ("word " * 100_000).strip(), *short])


def test_thresholds_decide(monkeypatch):
    """With a higher surge or a narrower window the weak ends of an article dive."""
    page = f"<article>{blocks('It is so.', 'On it goes.', *[LONG] * 6, 'Here it ends.', 'x', 'y', tag='p')}</article>"
    whole = html_text.main_text(page)
    assert whole.startswith("It is so.") and whole.endswith("x y")
    monkeypatch.setattr(html_text, "SURGE", 0.3)
    assert html_text.main_text(page).endswith("Here it ends. x y") and html_text.main_text(page).startswith("It is so.")
    monkeypatch.setattr(html_text, "WINDOW", 1)
    assert html_text.main_text(page) == " ".join([LONG] * 6)
    monkeypatch.setattr(html_text, "WINDOW", 2)
    assert html_text.main_text(page) == " ".join(["On it goes.", *[LONG] * 6, "Here it ends."])


def test_windows_against_counting_them(monkeypatch):
    """The lines of an article that stay are those between the first and the last window above the threshold."""
    import random
    import statistics

    r = random.Random(3)
    monkeypatch.setattr(html_text, "SURGE", 0.8)
    for _ in range(40):
        lines = ["x" * r.choice([1, 3, 30, 200]) for _ in range(r.randrange(1, 25))]
        sums = [sum(map(len, lines[i : i + html_text.WINDOW])) for i in range(len(lines))]
        above = [i for i, s in enumerate(sums) if s > 0.8 * statistics.median(sums)]
        want = lines[above[0] : above[-1] + html_text.WINDOW] if above else []
        assert html_text.main_text(f"<main>{blocks(*lines, tag='p')}</main>") == " ".join(want)
