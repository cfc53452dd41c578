from docloom.llm.bpe import Vocabulary


def test_words_are_kept_once_and_given_up_at_the_end_of_a_task():
    ranks = {bytes([i]): i for i in range(256)} | {b" a": 256, b"bc": 257}
    known = Vocabulary(ranks, r" ?[a-z]+|\s+|[^a-z]+")
    texts = ["x abc a bc", "a bc  bc abc", "abc"]
    ids = list(known.encode_all(texts))
    assert set(known._words) >= {"abc", "a", "bc"}
    assert not {" " + word for word in known._words} & set(known._pieces) - {" bc", " abc"}
    known.forget()
    assert not (known._words or known._pieces or known._pairs)
    assert list(known.encode_all(texts)) == ids
    assert [known.decode(i) for i in ids] == [t.encode() for t in texts]


def test_fewer_remembered_words_give_the_same_ids():
    ranks = {bytes([i]): i for i in range(256)} | {b" a": 256, b"bc": 257}
    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(100)]
    texts = [" ".join(words[i:] + words[:i]) for i in range(20)]
    known, brief = (Vocabulary(ranks, r" ?[a-z]+|\s+|[^a-z]+") for _ in range(2))
    brief.remember = 10
    assert list(brief.encode_all(texts)) == list(known.encode_all(texts))
    assert len(known._words) >= 99
    assert max(map(len, (brief._words, brief._pieces, brief._pairs))) <= 10
