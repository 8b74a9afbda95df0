from tokenizers import Tokenizer
from tallyspark.llm import token_counts as C
from tallyspark.llm import tokens


def test_against_the_library(edge_docs, sf_docs, same):
    lib = Tokenizer.from_file(tokens.default_path())
    for df in (edge_docs, sf_docs):
        want = []
        for r in df.select("doc_id", "text").collect():
            n = len(lib.encode(r[1] or "", add_special_tokens=False).ids)
            want.append({"doc_id": r[0], "n_bytes": len((r[1] or "").encode()), "n_tokens": n, "over_limit": n > 1024})
        same(C.token_counts(df), want)


def test_cuts_are_safe():
    lib = Tokenizer.from_file(tokens.default_path())
    enc = tokens.Encoder(tokens.default_path())
    hard = ["a  b", "a \n b", "x\n y  ", "<|endoftext|> a<|endoftext|>b  <|endoftext|>  ", "", " ", " a", "don't 's  's",
            "\x1c \x1c a", "é   b c", "it's  'll  12 34\t \t5 ", "漢字 かな", "a\xa0 b \xa0 c", "x" * 5000 + " " * 300 + "y",
            "ab  cd <|endoftext|> " * 9000]
    for text in hard:
        for size in (1, 7, tokens.PART_CHARS):
            pieces = tokens.parts(text, size)
            assert "".join(pieces) == text
            ids = [i for x in pieces for i in lib.encode(x, add_special_tokens=False).ids] if len(text) < 10000 or size > 7 else None
            assert ids is None or ids == lib.encode(text, add_special_tokens=False).ids
        assert list(enc.ids(text)) == lib.encode(text, add_special_tokens=False).ids


def test_empty_table(no_docs):
    assert C.token_counts(no_docs).count() == 0


def test_batches_are_balanced_by_bytes():
    assert [len(b) for b in tokens.balanced(["漢" * 100, "a" * 100, "b" * 200, "漢" * 200], 300)] == [1, 2, 1]


def test_batches_go_to_the_libraries_whole():
    class Seen:
        def __init__(self, inner):
            self.inner, self.calls = inner, []

        def encode_batch(self, texts, **kw):
            self.calls.append(len(texts))
            return self.inner.encode_batch(texts, **kw)

        def encode_ordinary_batch(self, texts, **kw):
            self.calls.append(len(texts))
            return self.inner.encode_ordinary_batch(texts, **kw)
    enc = tokens.Encoder(tokens.default_path())
    texts = ["plain words", "漢字 かな", "", "more words " * 50, "a <|endoftext|>"]
    want = [len(enc.ids(x)) for x in texts]
    enc.library, enc.fast = Seen(enc.library), Seen(enc.fast)
    assert enc.lengths(texts) == want
    assert enc.library.calls == [2] and enc.fast.calls == [3]
