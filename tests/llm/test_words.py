import random

from tessellum.llm import _words


def check(raw):
    h, starts = _words.word_hashes(raw)
    words = raw.split()
    assert len(h) == len(words)
    at = 0
    for w, s in zip(words, starts.tolist()):
        at = raw.index(w, at)
        assert s == at
        at += len(w)
    return dict(zip(words, h.tolist()))


def test_words_and_places(monkeypatch):
    rng = random.Random(1)
    raw = "".join(rng.choice(["a", "bc", "é漢", " ", "\n", "\t\r ", "\x0b\x0c", "\x1c", "\xa0", "word", "w" * 70]) for _ in range(20_000)).encode()
    whole = check(raw)
    assert len(set(whole.values())) == len(whole)
    for text in (b"", b" ", b"a", b" a", b"a ", b"\n\na b\n"):
        check(text)
    monkeypatch.setattr(_words, "SEGMENT", 64)
    _words._fixed_powers.cache_clear()
    assert check(raw) == whole  # in any segments, with words longer than one
    _words._fixed_powers.cache_clear()


def test_anagrams_and_repeats_differ():
    words = {"".join(rng) for rng in (random.Random(k).choices("ab", k=random.Random(k).randrange(1, 30)) for k in range(20_000))}
    h, _ = _words.word_hashes(" ".join(words).encode())
    assert len(set(h.tolist())) == len(words)


def test_words_of_each_text():
    h, _, sizes = _words.joined([b"a b", b"", b" \n ", b"a\nb c", b"b"])
    assert sizes.tolist() == [2, 0, 0, 3, 1] and h[0] == h[2] and h[1] == h[3] == h[5]
    assert _words.joined([])[2].tolist() == []
