"""Texts encoded together have the ids of each text alone, and each distinct piece is looked up once."""

import random

import pyarrow as pa
import pytest

from panelwright.llm import tokens
from panelwright.llm.tokens import Encoder, tokenizer_path

from . import brute
from .test_edges import EXAMPLES, prose

TEXTS = [
    *EXAMPLES, "a\nb", "a.\nB c,\nd", "\na", "a\n", "a\n\nb", "a \nb", "a\n b", " a", "a ", "a  b", "ünï\nÇa va", "ſ\nx", "x y z",
    "a<|endoftext|>b\n<|endoftext|> c", "it's\n'll they'll", "12\n34 5", "😀\n😀 a", "tab\there now", " x y", "a\r\nb",
]


class Counted(dict):
    asked = 0

    def __init__(self, pieces):
        self.pieces = pieces

    def __getitem__(self, piece):
        self.asked += 1
        return self.pieces[piece]


@pytest.mark.parametrize("together", [1, 300, tokens.TOGETHER_BYTES])
def test_same_ids_as_the_library(monkeypatch, together):
    monkeypatch.setattr(tokens, "TOGETHER_BYTES", together)
    r = random.Random(1)
    texts = TEXTS + ["".join(r.choice("ab Ç.\n1'") for _ in range(r.randint(0, 12))) for _ in range(2000)]
    want = [pa.array(brute.ids(t), pa.uint32()).to_numpy().tobytes() for t in texts]
    encoder, column = Encoder(tokenizer_path()), pa.array(texts, pa.string())
    assert list(encoder.encode_all(column)) == want
    assert list(encoder.encode_all(column.slice(7, 50))) == want[7:57]
    assert list(encoder.encode_all(column.slice(0, 0))) == []


def test_a_piece_is_looked_up_once():
    encoder = Encoder(tokenizer_path())
    encoder._after_space = counted = Counted(encoder._after_space)
    texts = ["begin " + prose(9, 300)] * 40
    assert len(set(encoder.encode_all(pa.array(texts)))) == 1
    assert counted.asked <= len(set(texts[0].split()))
