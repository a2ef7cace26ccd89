"""Hidden elements that are empty, nested or never closed; the sample of words."""

import time

import pytest

from relcast.llm import html_text
from relcast.llm.common import prepare


def texts(page):
    return [b[1] for b in html_text.leaf_blocks(page, html_text.Paths())]


@pytest.mark.parametrize("page", [
    "<p>one <svg class='i'/>two</p><p>three</p>",
    "<p>one <math/>two</p><p>three</p>",
    "<p>one <svg/>two</p><p>three</p><svg><text>no</text></svg>",
    "<p>one <svg><svg><text>no</text></svg><text>no</text></svg>two</p><p>three</p>",
    "<p>one <template><template>no</template><p>no</template>two</p><p>three</p>",
    "<p>one <svg><title/><g/><text>no</text></svg>two</p><p>three</p>",
    "<p>one <template><script>'</template>'</script>no</template>two</p><p>three</p>",
    "<p>one <object><object>no</object>no</object>two</p><p>three</p>",
    "<p>one <!-- <svg> --><svg><!-- </svg> -->no</svg>two</p><p>three</p>",
    *(f"<p>one <{t}>two</p><p>three</p>" for t in ("noscript", "template", "svg", "math", "object", "noframes"))])
def test_hidden_elements(page):
    assert texts(page) == ["one two", "three"]


def test_raw_elements_run_to_their_close():
    assert texts("<p>a</p><script>x = '<svg><p>no</p>'</script><p>b</p><style>p</style><textarea><p>no</textarea><p>c") == ["a", "b", "c"]
    assert texts("<p>a</p><script>never closed <p>no</p>") == ["a"]


def test_many_unclosed_elements_take_one_pass():
    page = "<svg><template>" * 20_000 + "<p>shown</p>" + "</svg>" * 10
    began = time.process_time()
    assert len(texts(page)) <= 1
    assert time.process_time() - began < 5


def test_word_sample_takes_each_page_once(spark, monkeypatch):
    sp = prepare(spark)
    rows = [(f"<p>same{i % 3} word</p>",) for i in range(600)] + [(f"<p>own{i}</p>",) for i in range(50)] + [(None,)]
    seen = []
    real = html_text.leaf_blocks
    monkeypatch.setattr(html_text, "leaf_blocks", lambda h, p: seen.append(h) or real(h, p))
    got = html_text.sample_words(sp.createDataFrame(rows, "html string").repartition(4), "html", 1000)
    assert len(seen) == 53 == len(set(seen)) and {"same0", "own49", "word"} <= set(got)
