import html
import re

import numpy as np
import pytest

from helpers import prose
from tieweave.llm import chat, extraction as ex

TURNS = "pair_id long, turn long, role string, text string"


def _format(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.turn, r.role, r.rendered)):
        out.setdefault((r.pair_id, r.part), []).append(r)
    return out


def test_prompt_once_and_masked_completions(spark):
    chosen = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "r"), (1, 3, "assistant", "good"), (2, 0, "user", "same"), (3, 0, "user", "only here"), (None, None, None, None)]
    rejected = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "r"), (1, 3, "assistant", "bad"), (1, 4, "user", "?"), (2, 0, "user", "same"), (2, 0, "user", "same")]
    c, r = spark.createDataFrame(chosen, TURNS), spark.createDataFrame(rejected, TURNS)
    got = _format(chat.preference_turns(c, r).collect())
    text = {k: "".join(x.rendered for x in v) for k, v in got.items()}
    assert text[1, "prompt"] == "<|user|>\nq\n<|assistant|>\na\n<|user|>\nr\n"
    assert (text[1, "chosen"], text[1, "rejected"]) == ("<|assistant|>\ngood\n", "<|assistant|>\nbad\n<|user|>\n?\n")
    assert text[2, "prompt"] == "<|user|>\nsame\n" and text[3, "chosen"] == "<|user|>\nonly here\n" and text[None, "chosen"] == "<|user|>\n\n"
    assert set(text) == {(1, "prompt"), (1, "chosen"), (1, "rejected"), (2, "prompt"), (3, "chosen"), (None, "chosen")}
    for (_, part), rows in got.items():
        for x in rows:
            learned = part != "prompt" and x.role == "assistant"
            assert (x.learned, x.n_chars, x.masked_chars) == (learned, len(x.rendered), len("<|assistant|>\n") if learned else len(x.rendered))


def test_pairs_from_conversations(spark):
    rows = [(1, 0, "user", "hello"), (1, 1, "assistant", "abcdef"), (1, 2, "user", "bye"), (2, 0, "user", "no reply"), (3, 0, "assistant", None), (None, 0, "user", "x")]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {k: "".join(x.rendered for x in v) for k, v in _format(chat.preference_turns(*chat.cut_short_pairs(conv)).collect()).items()}
    assert got == {
        (1, "prompt"): "<|user|>\nhello\n", (1, "chosen"): "<|assistant|>\nabcdef\n", (1, "rejected"): "<|assistant|>\nabc\n", (2, "prompt"): "<|user|>\nno reply\n",
        (3, "prompt"): "<|assistant|>\n\n", (None, "prompt"): "<|user|>\nx\n",
    }
    assert chat.preference_turns(*chat.cut_short_pairs(conv.filter("false"))).count() == 0


def test_blocks_of_broken_markup():
    page = "<html><head><title>T</title><script>var t='</p>';</script><style>p{}</style></head><body><!-- x <p>no</p> --><nav><ul><li><a href='/x'>Home</a><li>About</ul></nav><article><h1>A &amp; B</h1><p>one <b>two<br>three<p>four&nbsp;&#233;</article><p>tail"
    found = ex.blocks(page)
    assert [b.text for b in found] == ["T", "Home", "About", "A & B", "one two three", "four é", "tail"]
    assert [b.in_main for b in found] == [False, False, False, True, True, True, False]
    assert found[1].linked == 4 and found[2].path == ("html", "body", "nav", "ul", "li")
    assert ex.blocks("") == [] and [b.text for b in ex.blocks("a < b <")] == ["a < b <"] and ex.blocks("<script>never closed") == []
    assert ex.blocks('<div class="side-bar x" id=\'k\' role=note>t</div>')[0].path == ("div", ".side", ".bar", ".x", ".k", ".note")


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    model = ex.BiLstm(5, hidden=3)
    model.p = {k: rng.normal(0, 0.5, v.shape) for k, v in model.p.items()}
    pages = [rng.normal(size=(n, 5)).astype(np.float32) for n in (4, 2, 6)]
    x, mask = model.padded(pages)
    y = (rng.random(mask.shape[:2]) < 0.5).astype(np.float32)

    def loss():
        p, _ = model.forward(x, mask)
        return float(-((y * np.log(p) + (1 - y) * np.log(1 - p)) * mask[:, :, 0]).sum() / mask.sum())

    grads = model.gradients(x, mask, y)
    for name, value in model.p.items():
        for _ in range(6):
            at = tuple(rng.integers(s) for s in value.shape)
            old, step = value[at], 1e-3
            value[at] = old + step
            up = loss()
            value[at] = old - step
            down = loss()
            value[at] = old
            assert abs((up - down) / (2 * step) - grads[name][at]) < 2e-4, name


def test_padding_and_batching_change_no_label():
    rng = np.random.default_rng(1)
    model = ex.BiLstm(4, hidden=3)
    pages = [rng.normal(size=(n, 4)).astype(np.float32) for n in (3, 9, 0, 1, 30)]
    for page, prob in zip(pages, model.label(pages), strict=True):
        assert len(prob) == len(page) and (not len(page) or np.allclose(prob, model.label([page])[0], atol=1e-5))


def _page(k):
    body = "".join(f"<p>{' '.join(prose(100 * k + i, 3 + 9 * (i % 4)))}.</p>" for i in range(5))
    return (
        f"<html><head><title>t{k}</title></head><body><nav><ul><li><a href='/a'>{' '.join(prose(k, 2))}</a></li></ul></nav><div class='ad'>{' '.join(prose(k + 7, 9))}.</div>"
        f"<article><h1>{' '.join(prose(k + 3, 6))}</h1>{body}</article><footer>&copy; {k}</footer></body></html>"
    )


@pytest.fixture(scope="module")
def labelled(spark):
    return [_page(k) for k in range(120)]


def _truth(page):
    inner = re.search(r"<article>(.*?)</article>", page).group(1)
    return "\n".join(html.unescape(re.sub("<[^>]*>", "", x)) for x in re.split(r"(?<=</p>)|(?<=</h1>)", inner) if x)


def test_held_out_pages_and_odd_ones(spark, labelled):
    pages = [(k, f"u{k}", h, "x") for k, h in enumerate(labelled)] + [(900, None, None, None), (901, "u", "", None), (None, "u", labelled[0], None), (902, "u", "<nav>" * 3000, None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text string")
    model = ex.train(labelled[:80])
    rows = {r.page_id: r for r in ex.extracted(df, model).collect()}
    right = [rows[k].text == _truth(labelled[k]) for k in range(80, 120)]
    assert sum(right) >= 39
    assert [rows[k].text for k in (900, 901, 902)] == ["", "", ""] and rows[None].text == rows[0].text
    assert all(r.n_chars == len(r.text) for r in rows.values())
    other = labelled[99].replace("<article>", "<div class='post'>").replace("</article>", "</div><div class='comments'><p>well said indeed</p></div>")
    found = ex.blocks(other)
    assert "\n".join(ex.main_blocks(found, model.label(ex.features([found]))[0])) == _truth(labelled[99])
    assert ex.main_texts(df.filter("false")).count() == 0


def test_without_pages_to_learn_from(spark):
    df = spark.createDataFrame([(1, "u", "<title>t</title><div class='menu'>m</div><div><p>text</p></div>")], "page_id long, url string, html string")
    assert ex.main_texts(df).first().text == "text"
