import numpy as np

from drivelaws.llm import packing, suffix


def test_a_batch_looks_each_word_up_once(monkeypatch):
    import public_tokenizers

    words = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    asked = []
    places = packing.Generation.places
    monkeypatch.setattr(packing.Generation, "places", lambda self, some: asked.append(len(some)) or places(self, some))
    texts = ["one two " * 500, "two three. ", "", "x y  Two\tone"]
    got = [ids.tolist() for ids in words.encode(texts)]
    assert max(asked) < 10
    assert got == [[*words.tokenizer.encode(t, add_special_tokens=False).ids, packing.END_ID] for t in texts]
    assert [ids.tolist() for ids in words.encode(texts[::-1])] == got[::-1]


def test_the_cache_of_words_moves_on():
    import public_tokenizers

    words = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"), most=8)
    for texts in (["a b c d", "b e"], ["f g a", "h b b"], ["i a f", "c"], ["a b c d e f g h"]):
        assert [ids.tolist() for ids in words.encode(texts)] == [
            [*words.tokenizer.encode(t, add_special_tokens=False).ids, packing.END_ID] for t in texts]


def test_suffixes_that_go_on_alike_are_not_sorted_again(monkeypatch):
    rng = np.random.default_rng(3)
    once = rng.integers(97, 123, 600).astype(np.uint8)
    other = once.copy()
    other[450] = 33
    data = np.concatenate([once, once, other])
    wanted = np.concatenate([np.arange(401) + 600 * i for i in range(3)])
    sorted_ = []
    lexsort = np.lexsort
    monkeypatch.setattr(suffix.np, "lexsort", lambda keys: sorted_.append(len(keys[0])) or lexsort(keys))
    array, _ = suffix.suffix_array(data, wanted, 200)
    text = data.tobytes()
    ahead = [text[i:i + 200] for i in array]
    assert sorted(array.tolist()) == wanted.tolist() and ahead == sorted(ahead)
    assert sum(sorted_) < 2 * len(wanted)
