"""The packing operator's tokenizer keeps the words it needs."""

import numpy as np

from orrery.llm import packing as P


def test_words_of_the_texts_at_hand_are_not_learned_again(monkeypatch):
    monkeypatch.setattr(P, "CACHED_WORDS", 3)
    words, learned = P.WordTokenizer(P.default_tokenizer()), []
    learn = words._learn
    monkeypatch.setattr(words, "_learn", lambda new: (learned.append(set(new)), learn(new)))
    texts = ["alpha b\u00eata, gamma delta", "Alpha b\u00eata, gamma other delta. gamma... <|x|>", "delta. (delta) b\u00eata 12 other-delta, other?!"]
    for text in texts:
        want = words.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(words.encode([text.encode()])[0], np.uint32).tolist() == want
    assert learned[1] == {b"Alpha", b"other", b"delta.", b"gamma...", b"<|x|>"}
    assert not learned[2] & {b"delta.", "b\u00eata,".encode()}
