"""Words are encoded by the model when they are first met; the library has only what isn't plain."""

import random

import pytest

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

from weftgraph.llm import op4_token_ids, op8_byte_bpe  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_plain_texts_need_no_library_call(monkeypatch):
    given = []

    class Seen:
        def __init__(self, inner):
            self.inner, self.model = inner, inner.model

        @classmethod
        def from_file(cls, path):
            return cls(whole.from_file(path))

        def get_added_tokens_decoder(self):
            return self.inner.get_added_tokens_decoder()

        def encode_batch_fast(self, texts, **options):
            given.extend(texts)
            return self.inner.encode_batch_fast(texts, **options)

    whole = tokenizers.Tokenizer
    monkeypatch.setattr(op4_token_ids, "_workers", {})
    monkeypatch.setattr(tokenizers, "Tokenizer", Seen)
    encode, _ = op4_token_ids._encoder(PATH, "<u2")
    encode(["Thoued, seßa! 2024 anhat*** (ueíja).", "Seit 12 Jahren", "it's x1", "a  b"])
    assert sorted(given) == [" x1", "a ", "it's"]


def test_equal_to_the_library_with_odd_spaces_and_repeats():
    draw = random.Random(3)
    some = [" ", " ", " ", "  ", "\n", " \n", "\t", " ", " ", "\x1c", "\x85", "​", "don't", "'s", "é", "日本", "a" * 70, "x1", "12", "3.5", "!?", "...", "Word", "word,", "ß", "٣", "\n\n", "—", "<|endoftext|>"]
    texts = ["".join(draw.choice(some) for _ in range(draw.randrange(25))) for _ in range(3000)] + ["", " ", "  ", "a ", " a", "\n a", "a" * 70 + " " + "a" * 70]
    encode, clear = op4_token_ids._encoder(PATH, "<u2")
    clear()
    want = tokenizers.Tokenizer.from_file(PATH).encode_batch_fast(texts, add_special_tokens=False)
    for got in (encode(texts), encode(texts)):
        assert [list(memoryview(x).cast("H")) for x in got] == [e.ids for e in want]
    plain = [t.replace("<|endoftext|>", "") for t in texts]
    bpe = op8_byte_bpe.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert bpe.encode(plain) == bpe._alone(plain)
