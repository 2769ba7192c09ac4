"""What coding by words costs, and texts whose words it must not take apart wrongly."""

import time

from geoloom.llm import token_alignment


def _coder():
    import public_tokenizers as public

    return token_alignment.ByteLevelCoder(public.path("byte_bpe_50k.json"), public.PATTERN)


def test_pieces_that_repeat_are_coded_once():
    coder = _coder()
    words = [f"alpha{i:x}'s-beta-gamma-delta-epsilon-zeta-eta-theta" for i in range(20_000)]
    split = [p for w in words for p in coder._split(" " + w)]
    start = time.process_time()
    coded = coder.tokenizer.encode(split, is_pretokenized=True, add_special_tokens=False)
    wanted = coded.ids
    every = time.process_time() - start
    start = time.process_time()
    pieces = [p for w in words for p in coder._split(" " + w)]
    splitting = time.process_time() - start
    start = time.process_time()
    ids, sizes = coder.code(words)
    took = time.process_time() - start
    assert (ids, len(pieces)) == (wanted, len(split)) and int(sizes.sum()) == len(wanted)
    assert took < every + splitting


def test_words_of_all_kinds():
    coder = _coder()
    words = ["a", "A1", "it's", "'s", "é", "naïve\nx", "\t", "  b", "日本", "x" * 3000, "<|endoftext|>", "ab c", "ﬁ"]
    ids, sizes = coder.code(words)
    at = 0
    for word, n in zip(words, sizes.tolist()):
        assert b"".join(coder.bytes_of[i] for i in ids[at : at + n]) == (" " + word).encode()
        assert ids[at : at + n] == coder.tokenizer.encode(coder._split(" " + word), is_pretokenized=True, add_special_tokens=False).ids
        at += n
    for text in ("a b", " a", "a ", "a\n", "\na", "a  b", "a \nb", "a\nb c", " ", "a  b", ""):
        assert token_alignment.words_of(text) == token_alignment._BETWEEN.split(text)
