import random

import numpy as np
import pytest

from tessera.llm.encoding import Encoder, to_alphabet, tokenizer_json
from tessera.llm.tree_bpe import TreeBPE

from .cases import some

ODD = ["", " ", "  ", "   ", "a  b", "a \n b", "x  \ny", " a", "a ", " a b", "foo<|endoftext|> bar", "a\x1cb c", "é é", "日本 語", "a\t\tb  ", "don't we'll", "½ x²", "a\n\n\nb c", "ǅ ʼ x", "a\u00a0b", "\u0130stanbul Straße", "a\u0301 é", "x" * 200]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_as_the_library(spark, name):
    e, rng = Encoder(tokenizer_json(name)), random.Random(1)
    assert e.shape
    texts = ODD + [r.text for r in some(spark).collect()]
    texts += ["".join(rng.choice("aZé ½\n\t'sß,.<|") for _ in range(rng.randint(1, 40))) for _ in range(500)]
    for text in texts:
        want = np.array(e.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert e.ids(text) == want, text


def test_tree_concatenation():
    tree, rng = TreeBPE(tokenizer_json("byte_bpe_50k.json"), leaf=8), random.Random(2)
    for _ in range(400):
        text = "".join(rng.choice(["the", "tion", "é", "a", "q", "ing", "xx", "ß"]) for _ in range(rng.randint(1, 200)))
        mapped = to_alphabet(text.encode())
        assert tree.tree(mapped) == tree.direct(mapped)
        cut = [tree.tree(mapped[k : k + 21]) for k in range(0, len(mapped), 21)]
        assert tree.joined(cut) == tree.direct(mapped)
    assert tree.halves and tree.windows


def test_trees_of_other_scripts():
    """Texts of all scripts, with special tokens and without, are split and joined as the library does."""
    tree, rng = TreeBPE(tokenizer_json("byte_bpe_50k.json"), leaf=8), random.Random(3)
    long = ["日本語" * 900, "кошка" * 700 + " дом", "ελληνικά" * 300 + "<|endoftext|>" + "漢" * 500, "\x1c" * 90 + "한국어" * 90]
    for text in ODD + long + ["".join(rng.choice(["日本", "кот", " ", "é", "\n", "<|endoftext|>", "🙂", "'s", "12", "\u3000"]) for _ in range(rng.randint(1, 120))) for _ in range(300)]:
        before = tree.windows
        want = tree.encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(tree.encode(text), "<u4").tolist() == want, text
        assert tree.windows > before or text not in long
        assert tree.decode(tree.encode(text)) == tree.encoder.tokenizer.decode(want, skip_special_tokens=False)


def test_other_tokenizers_go_to_the_library():
    import json

    spec = json.loads(tokenizer_json("byte_bpe_50k.json"))
    spec["pre_tokenizer"]["add_prefix_space"] = True
    e = Encoder(json.dumps(spec))
    assert e.shape is None
    assert np.frombuffer(e.ids("hello there"), "<u4").tolist() == e.tokenizer.encode("hello there", add_special_tokens=False).ids
    with pytest.raises(ValueError):
        TreeBPE(json.dumps(spec))
