"""The page scanner on bad markup, and the labeller on long pages and on pages labelled by hand."""

import os
import subprocess
import sys

import pytest
from conftest import ROOT
from html_pages import PAGES

from flowloom.llm import html_text as ht


def texts(page):
    return [b.text for b in ht.blocks(page)]


@pytest.mark.parametrize(
    "page,want",
    [
        ("<html><head><title>x</title><p>Body text here.</p>", ["Body text here."]),
        ("<head>words at once<p>more", ["words at once", "more"]),
        ('<head><script>var s="<!--";</script></head><body><p>Hello', ["Hello"]),
        ("<div data-x=it's><p>First para.</p><p>Second, don't drop.", ["First para.", "Second, don't drop."]),
        ("<a title=\"a > b\">x</a> <i data-y='>'>y</i>", ["x y"]),
        ("<p>a</p><svg width=9 /><p>b</p>", ["a", "b"]),
        ("<svg><svg></svg><text>leak</text></svg><p>b", ["b"]),
        ("<canvas><p>keep", ["keep"]),
        ("<p>a</p><object><p>b</p>", ["a", "b"]),
        ("<noscript>turn it on</noscript><p>b", ["b"]),
        ("<!-- no end <p>x</p> y", ["x", "y"]),
        ("<p>a<!-->b<!-- c --!>d</p>", ["abd"]),
        ("a <b>c</b> 1 < 2 <3 & &amp; x", ["a c 1 < 2 <3 & & x"]),
        ("<p>x</p><textarea><p>no</p></textarea><select><option>z</select><p>y", ["x", "y"]),
        ("<title>no end<p>x", ["no end", "x"]),
        ("<script src=x /><p>x", ["x"]),
        ("<script>gone<p>x", []),
        ("</p></p></div>x</span>y", ["xy"]),
        ("", []),
    ],
)
def test_nothing_is_lost_to_bad_markup(page, want):
    assert texts(page) == want


@pytest.mark.parametrize("page", ["<div class='a b'>" * 6000 + "x" + "</span>" * 6000, "<svg>" * 20_000 + "x", "<!-- a>" * 50_000 + "x", "<title>" * 20_000 + "x", "<a href=\"" * 20_000 + ">x"])
def test_nested_and_endless_elements_take_bounded_work(page):
    found = ht.blocks(page)
    assert [b.text[-1:] for b in found] == ["x"] and len(found[0].path) <= ht.PATH_ELEMENTS * ht.NAMES_AN_ELEMENT


def test_a_long_page_in_windows_equals_one_sequence(monkeypatch):
    model = ht.Labeller()
    page = ht.blocks("<nav><a href=/>x</a></nav><article>" + "".join(f"<p>some words {i}, and more.</p>" for i in range(700)) + "</article><footer>f</footer>")
    whole = model.label([page])[0]
    monkeypatch.setattr(ht, "CELLS", 64)
    model.p["k"] -= model.p["k"]
    assert (model.label([page])[0] == whole).mean() == 1


def test_memory_of_a_page_of_many_blocks():
    code = (
        "import resource; from flowloom.llm import html_text as ht; m = ht.Labeller(); "
        "page = ht.blocks('<body>' + '<div>' * 400 + '<p>some words here, and there.</p>' * 100_000); small = [ht.blocks('<p>a</p>')] * 63; "
        "assert len(m.label([page, *small])[0]) == 100_000; print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)"
    )
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=ROOT, env=os.environ | {"PYTHONPATH": ROOT}, timeout=300)
    assert said.returncode == 0, said.stderr
    assert int(said.stdout.split()[-1]) < 500_000  # KB


def test_pages_labelled_by_hand(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    model = ht.learn([r["html"] for r in pages])
    own = [ht.blocks(h) for h, _ in PAGES]
    right = total = 0
    for page, marks, (_, text) in zip(own, model.label(own), PAGES):
        main = text.split("\n")
        assert set(main) <= {b.text for b in page}
        right += sum((b.text in main) == bool(m) for b, m in zip(page, marks))
        total += len(page)
    assert right >= 0.9 * total, (right, total)


def test_names_can_be_hidden_without_a_change_of_blocks():
    for html, _ in PAGES:
        hidden = ht.blocks(ht.plain_names(html))
        assert [b.text for b in hidden] == texts(html) and not any(t.startswith(".") for b in hidden for t in b.path)
