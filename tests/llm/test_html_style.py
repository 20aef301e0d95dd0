"""Visibility by a page's own style sheets, and layouts of the caller's."""

import time

import pytest

from plumbline.llm.html_style import Styles, declared
from plumbline.llm.html_text import Layout, render


def seen(css, body, attributes=""):
    return render(f"<html><head><style {attributes}>{css}</style></head><body>{body}</body></html>").split()


@pytest.mark.parametrize(
    "css,body,shown",
    [
        (".x{display:none}", "<p class='x'>no</p><p class='y x z'>no</p><p class='X'>yes</p>", "yes"),
        ("#top { DISPLAY : None }", "<div id=top>no<p>no</p></div><div id=Top>yes</div>", "yes"),
        ("p.a.b, #c{display:none}", "<p class='b a'>no</p><p class=a>yes</p><div class='a b'>too</div><i id=c>no</i>", "yes too"),
        (".x{display:none} p.x{display:block}", "<p class=x>yes</p><i class=x>no</i>", "yes"),
        ("p.x{display:block} .x{display:none}", "<p class=x>yes</p>", "yes"),
        (".x{display:none!important} p.x{display:block}", "<p class=x>no</p>", ""),
        (".x{display:none}", "<p class=x style='display:block'>yes</p>", "yes"),
        (".x{display:none !important}", "<p class=x style='display:block'>no</p><p class=x style='display:inline!important'>yes</p>", "yes"),
        (".x{display:block}", "<p hidden class=x>yes</p><p hidden>no</p>", "yes"),
        (".x{visibility:hidden}.y{visibility:visible}", "<p class=x>no <b class=y>yes</b> no</p>after", "yes after"),
        ("*{visibility:hidden}", "<p>no</p>", ""),
        ("/* .x{display:none} */ .y{display:none}", "<p class=x>yes</p><p class=y>no</p>", "yes"),
        (".x{color:red;display:none;width:1px}", "<p class=x>no</p>", ""),
        (".x{display:none;display:block}", "<p class=x>yes</p>", "yes"),
        ("@media print{.x{display:none} .z{display:none}} .y{display:none}", "<p class=x>yes</p><p class=y>no</p>", "yes"),
        ("@media screen{.x{display:none}} .y{display:none} @import url(x);.z{display:none}", "<p class=x>no</p><p class=y>no</p><p class=z>no</p>yes", "yes"),
        ("@media screen and (max-width:9px){.x{display:none}}", "<p class=x>yes</p>", "yes"),
        ("@font-face{src:url(a)} div .x{display:none} .x:hover{display:none} .x>i{display:none} [x]{display:none}", "<div><p class=x x>yes <i>too</i></p></div>", "yes too"),
        (".x{display:none", "<p class=x>no</p>yes", "yes"),
        ("} .x{display:none}", "<p class=x>?</p>yes", None),
        ("<!-- .x{display:none} -->", "<p class=x>no</p>yes", "yes"),
    ],
)
def test_rules(css, body, shown):
    got = seen(css, body)
    assert shown is None or got == shown.split()


def test_which_sheets_count():
    body = "<p class=x>yes</p>"
    assert seen(".x{display:none}", body, "type='text/less'") == ["yes"] and seen(".x{display:none}", body, "media=print") == ["yes"]
    assert seen(".x{display:none}", body, "type='TEXT/CSS' media=screen") == []
    assert render("<p class=x>one</p><style>.x{display:none}</style><p class=x>two</p>") == "one"
    assert render("<template><style>.x{display:none}</style></template><p class=x>yes</p>") == "yes"
    assert declared("display:none; display: bogus !important ;visibility:inherit") == {"display": (True, False)}


def test_time_follows_the_page():
    def took(n):
        sheet = "".join(f".a{i}.b{i % 97},#i{i}{{display:none}}@media print{{x{{y:z}}}}" for i in range(n)) + "/*" * n
        page = f"<style>{sheet}</style>" + "".join(f"<p class='b{i % 97} a{i} c'>t</p>" for i in range(n))
        began = time.perf_counter()
        assert render(page) == ""
        return time.perf_counter() - began

    took(500)
    assert took(8000) < 12 * took(2000) + 0.2


def test_same_selector_is_one_rule():
    styles = Styles()
    for i in range(50):
        styles.sheet(f".x{{display:{'none' if i % 2 else 'block'}}}")
    assert sum(map(len, styles.rules.values())) == 1 and styles.decide("p", {"class": "x"}) == {"display": True}


def test_layouts_of_the_callers():
    page = "<table><tr><td>" + "w" * 150 + "<td>b<tr><td>a<td>b</table>"
    narrow, wide = render(page).split("\n"), render(page, Layout(column=200)).split("\n")
    assert narrow[1].index("b") < 130 and wide[1].index("b") == wide[0].index("b") == 152
    deep = "<blockquote>" * 30 + "x"
    assert len(render(deep)) < len(render(deep, Layout(indent=500)))
