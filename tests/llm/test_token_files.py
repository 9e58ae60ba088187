import zlib

import numpy as np
import pytest

from labelspark.llm import token_files

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def path():
    return public_tokenizers.path("word_bpe_49k.json")


def plain(rows, path):
    tokenizer = tokenizers.Tokenizer.from_file(path)
    out, start = [], 0
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_hold_what_the_tokenizer_gives(spark, frame, words, path, tmp_path):
    rows = [(i * 37 % 500, words(i, i % 50)) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, " \n\t\x1c\x85   x"), (1003, "Don't STOP <|endoftext|> it's"), (1004, "é ́x ﬁ Ǆ ΑΣ"),
             (1005, words(5, 30_000)), (1006, "x" * 20_000), (1007, "😀‍😀 日本語 ١٢٣"), (None, "null id"), (-5, "negative  id\r\nx")]
    manifest = token_files.write_token_files(frame(rows).repartition(6), path, folder=f"file://{tmp_path}/t")
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_token_files(manifest, 2).orderBy("start").collect()]
    assert got == plain(rows, path)
    parts = manifest.orderBy("part").collect()
    whole = np.concatenate([np.memmap(f"{tmp_path}/t/part-{p.part:06d}.bin", "<u2", "r") for p in parts if p.n_tokens])
    assert len(whole) == sum(p.n_tokens for p in parts) == got[-1][1] + got[-1][2]
    assert not [p for p in (tmp_path / "t").iterdir() if p.name.startswith("_")]


def test_repeated_rows_and_empty_table(frame, path):
    rows = [(1, "same text here")] * 3 + [(1, "other")]
    manifest = token_files.write_token_files(frame(rows), path)
    got = token_files.read_token_files(manifest, 2).collect()
    want = plain(rows, path)
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == sorted((k, n, c) for k, _, n, c in want)
    assert sorted(r.start for r in got)[0] == 0
    assert token_files.read_token_files(token_files.write_token_files(frame([]), path), 2).count() == 0


def test_wide_ids(frame, path):
    assert token_files.id_width(path, 1) == 2 and token_files.id_width(path, 1 << 17) == 4
    manifest = token_files.write_token_files(frame([(1, "a b"), (2, None)]), path, end_id=1 << 17)
    got = token_files.read_token_files(manifest, 4).orderBy("start").collect()
    assert got[1].ids_crc32 == zlib.crc32(np.array([1 << 17], "<u4").tobytes())


def test_reading_in_small_blocks(frame, words, path, monkeypatch):
    monkeypatch.setattr(token_files, "READ_TOKENS", 10)
    rows = [(i, words(i, i % 30)) for i in range(60)]
    manifest = token_files.write_token_files(frame(rows), path)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_token_files(manifest, 2).orderBy("start").collect()]
    assert got == plain(rows, path)
