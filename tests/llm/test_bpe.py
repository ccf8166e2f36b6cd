"""Chunked encoding against the library's own, text by text."""

import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tokenizers import Tokenizer

from odresil.llm import bpe
from odresil.llm.bpe import ColumnEncoder

CASES = ["hello <|endoftext|> world", "a.\nB\nc\n", "é,\n€, ×, ÷. ñ!? \n", "x\n\ny", "\n", "a\n b", "3.\n4,", "a<|startoftext|>b", "<|ENDOFTEXT|>", "x  <|endoftext|>\n", "", " ", "  a", "a  b", "a\nb c", "a \n b", "it's we'll 'tis x' y's.", "<|endoftext|> x", "Éá b c", "x\t y", "12 3a4", "a\x1cb \x1c c", "ÇA va!!", "ﬁ İx ΑΣ", "日本 語", "　x 　y", None, "don't, 'S 'll", "a\x85 b", "ß ẞ straße."]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_same_ids(name):
    coder = ColumnEncoder(public_tokenizers.path(name))
    texts = CASES + pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    check(coder, Tokenizer.from_file(public_tokenizers.path(name)), texts)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_forgetting(name, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    coder, plain = ColumnEncoder(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
    for k in range(30):
        check(coder, plain, [f"word{j} other-{j * k}, <|endoftext|>  {k}" for j in range(k, k + 40)])
        assert coder.count <= 400


NAMES = ("byte_bpe_50k.json", "word_bpe_49k.json")
CODERS = [(ColumnEncoder(public_tokenizers.path(n)), Tokenizer.from_file(public_tokenizers.path(n))) for n in NAMES]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.one_of(st.text(alphabet=" \n\t'saéÉ.,!1&×€́ \x1c\x85İ", max_size=14), st.text(max_size=12), st.sampled_from(["<|endoftext|>", "a <|endoftext|>b", "<|startoftext|> "])), max_size=4))
def test_any_text(texts):
    for coder, plain in CODERS:
        check(coder, plain, texts)


def check(coder, plain, texts):
    ids, at = coder.encode(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        want = plain.encode(text or "", add_special_tokens=False).ids
        assert ids[at[i] : at[i + 1]].tolist() == want, text
