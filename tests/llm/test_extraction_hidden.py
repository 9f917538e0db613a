import pytest

from tieweave.llm import extraction as ex


def _texts(page):
    return [b.text for b in ex.blocks(page)]


@pytest.mark.parametrize("tag", ["svg", "math", "iframe", "object", "select", "template", "canvas", "audio", "video"])
def test_self_closed_elements_are_empty(tag):
    assert _texts(f"<body><p>one <{tag} class='x'/> two</p><p>three</p><{tag}>").count("one two") == 1
    assert _texts(f"<article><{tag}/><p>one</p></article><div>two<{tag}></{tag}></div><p>three") == ["one", "two", "three"]


@pytest.mark.parametrize("tag", ["svg", "iframe", "object", "select", "noscript", "template", "video"])
def test_unclosed_elements_end_with_their_block(tag):
    assert _texts(f"<body><div>one<{tag} id=x></div><p>two</p><p>three <{tag}></{tag}>four</p></body>") == ["one", "two", "three four"]
    assert _texts(f"<body><{tag} id=x><p>two</p><p>three</p></body>") == ["two", "three"]


def test_closed_elements_stay_hidden_and_shown_text_stays():
    assert _texts("<div>a<template><div><p>x</p></div></template>b</div>") == ["a b"]
    assert _texts("<p>a<svg><g><title>x</title></g><svg><path d='m'></svg>y</svg>b<select><option>x<option>y</select>") == ["a b"]
    assert _texts("<article><p>if <math><mi>x</mi><mo>=</mo><mn>2</mn></math> then</p><noscript><p>plain</p></noscript><object>told</object></article>") == ["if x=2 then", "plain", "told"]
    assert _texts("<p>a<script/>x</p><p>y") == ["a"] and _texts("<p>a<textarea>x</p><p>y") == ["a"]
