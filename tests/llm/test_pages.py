"""Main text where comments, forms and lists stand in its way, and deep pages in linear time; tokens of control characters."""

import random
import time

from earwitness.llm import html, packing

P = "<p>{} sentence, with a comma, and some more words to read here.</p>"


def paragraphs(name, n):
    return "".join(P.format(f"{name}{k}") for k in range(n))


def test_comments_never_win():
    post, thread = paragraphs("post", 2), paragraphs("reader", 40)
    for page in (f"<div class=post>{post}</div><div id=comments>{thread}</div>", f"<main><div class=post>{post}</div><div id=comments>{thread}</div></main>",
                 f"<article>{post}<section class='comment-list'><article>{thread}</article></section></article>",
                 f"<article>{post}<section><article>{thread}</article><article>{thread}</article></section></article>",
                 f"<div class='content has-comments'>{post}</div><ol class=commentlist><li class=comment>{thread}</ol>"):
        text = html.main_text(f"<html><body>{page}</body></html>")
        assert "post0" in text and "post1" in text and "reader" not in text, page[:60]
    assert "reader39" in html.main_text(f"<body><div id=comments>{thread}</div></body>")


def test_forms_that_hold_the_article():
    page = f"<body><form action=x><input name=y>{paragraphs('post', 5)}<button>Send</button></form></body>"
    assert html.main_text(page).startswith("post0") and "Send" not in html.main_text(page)
    page = f"<body><article>{paragraphs('post', 5)}<form>Write your name <p>here, please.</p></form></article></body>"
    assert "please" not in html.main_text(page) and "post4" in html.main_text(page)


def test_lists_of_links():
    links = "".join(f"<li><a href=/{k}>Source {k}</a></li>" for k in range(5))
    assert "Source 4" in html.main_text(f"<body><article>{paragraphs('post', 3)}<h2>References</h2><ul>{links}</ul></article></body>")
    assert "Source 4" not in html.main_text(f"<body><div><ul>{links}</ul>{paragraphs('post', 3)}</div></body>")


def test_deep_and_broken_pages_take_linear_time():
    for unit in ("<div><p>x, y</p>", "<b>x</i>", "<span><p>x", "<ul><li>x", "<p><b>x", "<div><ul><li><a href=y>x</a></ul>"):
        began = time.process_time()
        html.main_text("<body>" + unit * 100_000)
        assert time.process_time() - began < 15, unit  # 2 s on an idle machine; a quadratic pass takes hours


def test_tokens_of_control_characters():
    from tokenizers import Tokenizer
    import public_tokenizers

    whole, parts = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), packing.WordTokens()
    rng = random.Random(3)
    texts = ["".join(rng.choices("ab.,;! \t\nÉ" + "".join(map(chr, range(32))) + "\x7f\x85\xa0", k=12)) for _ in range(20_000)]
    for text, raw in zip(texts, parts.ids(texts), strict=True):
        want = whole.encode(text, add_special_tokens=False).ids
        assert list(memoryview(bytes(raw)).cast("I"))[: len(want)] == want, repr(text)
