import random
import zlib

import pytest

from playlore.llm import packing


@pytest.mark.parametrize("seed", range(8))
def test_plan_fills_sequences_without_gaps_or_overflow(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 2048])
    histogram = {n: rng.choice([0, 1, 2, 7, 40]) for n in range(1, capacity + 1) if rng.random() < 0.7}
    bins = {}
    seen = dict.fromkeys(histogram, 0)
    for length, first, count, base, offset, each in packing.plan(histogram, capacity):
        assert first == seen[length]
        seen[length] += count
        for i in range(count):
            bins.setdefault(base + i // each, []).append((offset + i % each * length, length))
    assert seen == histogram
    for held in bins.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= capacity
    total = sum(n * c for n, c in histogram.items())
    large = sum(c for n, c in histogram.items() if 2 * n > capacity)
    assert len(bins) <= max(1.23 * max(total / capacity, large) + 1, 1)


def test_words_give_the_ids_of_whole_texts():
    words = packing.WordIds(packing.TOKENIZER)
    texts = ["", "Hello, World. It's 12 o'clock!!", "Á é. Café au lait,\tx.y...z", "<|endoftext|> <|ENDOFTEXT|> a<|startoftext|>b", "don't.Stop, Kelvin İstanbul. \U0001f600,", "\x0b\x0c\x1c a\x1db 　c"]
    for t in texts:
        want = words.tokenizer.encode(t, add_special_tokens=False).ids
        got = words.of(t.encode())
        assert [int.from_bytes(got[i : i + 4], "little") for i in range(0, len(got), 4)] == want, t


def test_pieces_and_places(spark):
    rows = [(1, "a " * 5000), (2, None), (3, ""), (None, "x"), (2, "b c"), (2, "b c")] + [(i, "word " * (i % 90)) for i in range(10, 400)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, length string")
    out = packing.pack_documents(docs).collect()
    first = sorted((r for r in out if r.doc_id == 1), key=lambda r: r.piece)
    assert [r.length for r in first] == [2048, 2048, 905] and [r.start for r in first] == [0, 2048, 4096]
    assert sum(r.doc_id == 2 for r in out) == 3
    assert next(r for r in out if r.doc_id == 3).ids_crc32 == zlib.crc32(bytes(4))
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(bins) <= sum(r.length for r in out) / 2048 + 2
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_words_of_plain_letters_skip_the_steps_before_the_model():
    words = packing.WordIds(packing.TOKENIZER)
    whole, asked = words.tokenizer, []

    class Counted:
        def encode(self, text, **kw):
            asked.append(text)
            return whole.encode(text, **kw)

    words.tokenizer = Counted()
    text = "menteiega oforstené, edesly$$$ ßüzu. auung!! 1.43 É'sÉ l'été a<|b don't x|> naı̈ve"
    ids = whole.encode(text, add_special_tokens=False).ids
    assert words.of(text.encode()) == b"".join(i.to_bytes(4, "little") for i in ids)
    assert not {"menteiega", "oforstené,", "oforstené", "edesly$$$", "edesly", "ßüzu.", "ßüzu", "auung!!", "auung"} & set(asked)


def test_a_tokenizer_that_joins_or_changes_plain_letters_is_asked_whole(tmp_path):
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

    odd = Tokenizer(models.WordLevel({"?": 0, "oof": 1, "foo": 2}, unk_token="?"))
    odd.normalizer, odd.pre_tokenizer = normalizers.Replace("foo", "oof"), pre_tokenizers.WhitespaceSplit()
    odd.save(f"{tmp_path}/odd.json")
    words = packing.WordIds(f"{tmp_path}/odd.json")
    assert words.model is None and words.of(b"foo oof") == (1).to_bytes(4, "little") * 2
