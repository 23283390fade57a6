import random
import struct

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from labeltrail.llm.token_files import WordEncoder, pack

PATH = public_tokenizers.path("byte_bpe_50k.json")


def library(texts):
    found = Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)
    return [np.array(e.ids, np.uint32).tobytes() for e in found]


def test_words_of_letters_go_to_the_model(monkeypatch):
    encode = WordEncoder(PATH)
    asked, real = [], encode._encode
    monkeypatch.setattr(encode, "_encode", lambda texts: asked.extend(texts) or real(texts))
    texts = ["One day the qurzel, blonté.\nAñadió growing; ended!!", "All of Größe.\nThen\nmore, more. End."]
    assert encode(texts) == library(texts)
    assert set(asked) <= {"One", "All", ".", ",", ";", "!!", "\n"}


def test_ids_of_odd_texts():
    bits = [
        "a", "Zé", "ǅx", "ɏ", "ɐb", "привет", "漢字", "don't", "'s", "x's", "12", "a1", "²", "ª", "_", "\x00", " ", "­", "́", "﻿",
        "\n", "\n\n", "\r\n", "\t", " ", "  ", ".", "!?", "...", "<|endoftext|>", "😀", " ", "\x85", "\x1c", "(b)", "-",
    ]
    pick = random.Random(3)
    texts = ["", " ", "\n", "a\n", "\na", " a\n b", "a\n" * 3_000] + ["".join(pick.choices(bits, k=pick.randrange(1, 14))) for _ in range(3_000)]
    texts += [" ".join(pick.choices(bits, k=8)) for _ in range(500)]
    expected = library(texts)
    for limit in (700_000, 20):
        found = WordEncoder(PATH, limit)(texts)
        assert [t for t, a, b in zip(texts, found, expected) if a != b] == []


def test_new_words_go_to_the_model_in_one_call(monkeypatch):
    encode = WordEncoder(PATH)
    asked, alone, real, letters = [], [], encode._encode, encode._letters
    monkeypatch.setattr(encode, "_encode", lambda texts: asked.extend(texts) or real(texts))
    monkeypatch.setattr(encode, "_letters", lambda *args: alone.append(args) or letters(*args))
    pick = random.Random(5)
    words = ["".join(pick.choices("abcdefghiñøß", k=9)) for _ in range(2_000)]
    texts = ["Then " + " ".join(words), "Then " + ", ".join(words), "Then (alpha)beta,gamma.delta; " + " ".join(words[:9])]
    assert encode(texts) == library(texts)
    assert len(alone) <= 5 and set(asked) <= {",", " (", ")", ".", ";"}


def test_ids_where_letters_signs_and_spaces_meet():
    bits = [
        "a", "é", "×", "÷", "ƻ", "ȿ", "ɀ", "б", "漢", "́", "'s", "'", ".", ",", "(", "|", "-", "7", " ", "\n", "\t", "\r", "\x1f", "\x85", "\xa0",
        " ", " ", "—", " ", " ", " ", "　", "、", "<|endoftext|>", "😀",
    ]
    pick = random.Random(7)
    texts = ["".join(pick.choices(bits, k=pick.randrange(0, 12))) for _ in range(6_000)] + ["漢" * 500, "a" * 500 + " " + "é" * 300]
    expected = library(texts)
    for limit in (700_000, 20):
        encode = WordEncoder(PATH, limit)
        found = [ids for k in range(0, len(texts), 700) for ids in encode(texts[k : k + 700])]
        assert [t for t, a, b in zip(texts, found, expected) if a != b] == []


def test_packed_bytes_are_as_documented():
    rng = np.random.default_rng(4)
    ids = np.where(rng.random((60, 128)) < 0.06, rng.integers(0, 2**32, (60, 128)), rng.integers(5, 5 + 2 ** rng.integers(0, 32, (60, 1)), (60, 128)))
    ids = np.vstack((ids, np.full((1, 128), 9), rng.integers(0, 2**32, (1, 128)))).astype(np.uint32)
    body, sizes = pack(ids.ravel())
    at = 0
    for own, size in zip(ids.tolist(), sizes.tolist()):
        base, width, n = struct.unpack_from("<IBB", body, at)
        words = struct.unpack_from(f"<{4 * width}I", body, at + 6)
        lanes = [sum(w << 32 * i for i, w in enumerate(words[lane::4])) for lane in range(4)]
        found = [lanes[k % 4] >> k // 4 * width & (1 << width) - 1 for k in range(128)]
        places = body[at + 6 + 16 * width :][:n]
        for k, high in zip(places, struct.unpack_from(f"<{n}I", body, at + 6 + 16 * width + n)):
            found[k] |= high << width
        assert base == min(own) and [base + x for x in found] == own and size == 6 + 16 * width + 5 * n
        at += size
    assert at == len(body)
