"""Latin words and the punctuation after them are encoded apart, with the library's ids."""

import numpy as np
import public_tokenizers

from daykeeper.llm.packing import WordBpe

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
LETTERS = [chr(k) for k in range(256) if chr(k).isalpha()]
MARKS = [chr(k) for k in range(33, 127) if not chr(k).isalnum()]


def test_words_with_marks_have_the_library_ids():
    texts = ["".join(f"{a}{b}e{m} x{a}{b}{m}{m}. " for b, m in zip(LETTERS * 2, MARKS * 5)) for a in LETTERS]
    texts += [" ".join(f"Étéx{a}{b}" for a in MARKS for b in MARKS), "it's don't' l'été'S x're'd 'll Ünd'", "(word) \"Wort\" a1! ½x x² été… naïve— Straße's"]
    texts += ["<|endoftext|> Ab<|endoftext|>c <|STARTOFTEXT|> ab<| É<|", "étude, École! ǅ ΑΣ, İx ſ ﬁn", "a\x00b x\x1c, y\x85z\xa0é. \x07", ""]
    coder = WordBpe(TOKENIZER)
    want = [np.array(coder.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes() for text in texts]
    assert coder.encode(texts) == want


def test_words_are_told_from_their_marks_before_the_library(monkeypatch):
    coder = WordBpe(TOKENIZER)
    asked = []
    words = coder._words
    monkeypatch.setattr(coder, "_words", lambda w: asked.extend(w) or words(w))
    coder.encode(["word... word!!! word, word?! (word"])
    assert asked == ["word"]
