"""SentencePiece, token counts, JPEG, WARC, licences: against libraries and brute force."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.llm import jpeg_media, license_rules, queries, warc
from tidelog.llm.common import arrow_map
from tidelog.llm.gam_quality import accepted, quality_scores
from tidelog.llm.license_rules import license_scan
from tidelog.llm.sentencepiece_bpe import MergeVocabulary, sentencepiece_round_trip, vocabulary
from tidelog.llm.token_counts import _tokenizer, count_batch, pieces, token_counts

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, shard string, score string, rep long, words long, w long, n long"
LONG = "thing and another " * 20_000
TEXTS = ["", None, "a", "a  b\tc\n\n d", "Ça va? <s> ▁x▁ 😀😀 <|endoftext|> end", "x" * 5000, "<|endoftext|>", " lead", "trail ", LONG, "a", "é" * 700, "\x00\x01", "…　…"]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(i // 2 if i < 4 else (None if i == 5 else i), t, None if i % 2 else "en", f"s{i % 3}", 1, 7, "x", "y", 5, 6, 8, 9) for i, t in enumerate(texts)], DOCS)


def by_text(df, frame):
    return frame.collect()


@pytest.fixture(scope="module")
def vocab():
    return vocabulary()


def test_agenda_equals_library(vocab):
    r = random.Random(3)
    odd = ["".join(r.choice("aeth \n▁é😀.-ñ  ") for _ in range(r.randrange(300))) for _ in range(400)] + [t or "" for t in TEXTS]
    assert vocab.encode_batch(odd) == vocab.sp.encode(odd)
    assert vocab.cuts


def test_list_and_heap_agendas_agree(vocab):
    r = random.Random(4)
    for _ in range(300):
        s = [r.choice("abehintr ou") for _ in range(r.randrange(1, 60))]
        assert vocab.merge_few(list(s)) == vocab.merge_many(list(s))


def test_cache_is_bounded():
    import sentencepiece

    small = MergeVocabulary(sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")), cached=10)
    texts = [f"w{i} and so on {i * 7}" for i in range(200)]
    for at in range(0, 200, 5):
        assert small.encode_batch(texts[at : at + 5]) == small.sp.encode(texts[at : at + 5])
        assert len(small.known) + len(small.older) < 80


def test_wrong_ids_are_an_error(vocab):
    broken = MergeVocabulary(vocab.sp)
    broken.ids = broken.ids | {" the": 5}
    with pytest.raises(ValueError, match="differ"):
        broken.encode_batch(["over the top"])


def test_sentencepiece_rows(spark, vocab):
    rows = sentencepiece_round_trip(docs(spark)).collect()
    assert len(rows) == len(TEXTS)
    want = []
    for t in TEXTS:
        ids = vocab.sp.encode(t or "")
        want.append((len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(vocab.sp.decode(ids).encode()).hexdigest()))
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == sorted(want)
    assert sentencepiece_round_trip(docs(spark).limit(0)).collect() == []


def test_other_operators_find_no_vocabulary_in_their_workers(spark):
    def held(batches):
        import os

        for b in batches:
            n = vocabulary.cache_info().currsize
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()] * b.num_rows), pa.array([n] * b.num_rows)], ["worker", "n"])

    def workers(owner):
        rows = arrow_map(spark.range(400).repartition(8), held, "worker long, n long", owner=owner).distinct().collect()
        return {r.worker for r in rows if r.n}

    before = docs(spark, [f"the brown fox {i}" for i in range(400)]).repartition(8)
    assert sentencepiece_round_trip(before).agg(F.sum("n_tokens")).first()[0] > 400
    assert workers("sentencepiece")
    assert not workers("another")


def test_accepted_scores_batches_in_slices_alike(spark):
    texts = [None, "", *(f"The brown fox {i} jumps over the lazy dog. " * (1 + i % 3) for i in range(2500))]
    d = docs(spark, texts).coalesce(1)
    labels = spark.createDataFrame([(i, i % 3) for i in range(0, 2500, 5)], "doc_id long, quality int").withColumn("quality", (F.col("quality") > 0).cast("int"))
    most = max(quality_scores(d, labels).toPandas()["score"])
    least = (most + 0.5) / 2
    want = {r.doc_id for r in quality_scores(d, labels, least).where("predicted = 1").collect()}
    assert {r.doc_id for r in accepted(d, labels, least).collect()} == want
    assert 0 < len(want) < len(texts)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=200), st.integers(1, 40))
def test_cut_texts_count_alike(text, cut):
    assert "".join(pieces(text, cut)) == text
    tok = _tokenizer(None)
    assert count_batch([text], None, cut, 1000) == [len(tok.encode(text, add_special_tokens=False))]


def test_token_count_rows(spark):
    tok = _tokenizer(None)
    rows = token_counts(docs(spark), cut=50).collect()
    want = [(len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False)), n > 512) for t in TEXTS]
    assert sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == sorted(want)
    assert token_counts(docs(spark).limit(0)).collect() == []


def test_media_rows(spark):
    rows = jpeg_media.media_columns(docs(spark)).collect()
    want = []
    for t in TEXTS:
        payload = jpeg_media.padded((t or "").encode())
        assert len(payload) % 576 == 0 and payload
        want.append((len((t or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])))
    assert sorted((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == sorted(want)
    same = {(r.media_sha256, r.feature) for r in rows if r.n_bytes == 1}
    assert len(same) == 1
    assert jpeg_media.media_columns(docs(spark).limit(0)).collect() == []


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=3000))
def test_jpeg_round_trip(data):
    payload = jpeg_media.padded(data)
    ((back, feature),) = jpeg_media.read_media([jpeg_media.write_media(payload)])
    assert back == payload and feature.startswith("72x")


def test_payload_of_several_pictures():
    payload = jpeg_media.padded(bytes(range(256)) * 20_000)
    ((back, feature),) = jpeg_media.read_media([jpeg_media.write_media(payload)])
    assert back == payload and len(feature.split(" ")) == 2


def _plain_jpeg(blocks, width, height, interval):
    """A baseline picture with ordinary tables (runs, end of block, DC differences), written
    bit by bit: a second writer to read against."""
    dc = {n: format(n, "04b") for n in range(12)}
    symbols = [0x00, 0xF0] + [r << 4 | s for r in range(16) for s in range(1, 11)]
    ac = {s: format(i, "08b") for i, s in enumerate(symbols)}
    size = lambda v: int(abs(v)).bit_length()
    bits_of = lambda v: format(v if v > 0 else v + (1 << size(v)) - 1, f"0{size(v)}b") if v else ""
    scan, bits, last = b"", "", 0

    def flush(b):
        b += "1" * (-len(b) % 8)
        return bytes(int(b[i : i + 8], 2) for i in range(0, len(b), 8)).replace(b"\xff", b"\xff\x00")

    for n, block in enumerate(blocks):
        if interval and n and n % interval == 0:
            scan += flush(bits) + bytes([0xFF, 0xD0 + (n // interval - 1) % 8])
            bits, last = "", 0
        d = int(block[0]) - last
        last = int(block[0])
        bits += dc[size(d)] + bits_of(d)
        run = 0
        for k in range(1, 64):
            v = int(block[k])
            if not v:
                run += 1
                continue
            while run > 15:
                bits += ac[0xF0]
                run -= 16
            bits += ac[run << 4 | size(v)] + bits_of(v)
            run = 0
        if run:
            bits += ac[0]
    scan += flush(bits)
    seg = jpeg_media._segment
    table = lambda head, length, syms: seg(0xC4, bytes([head] + [len(syms) if i == length - 1 else 0 for i in range(16)] + syms))
    out = b"\xff\xd8" + seg(0xE0, b"JFIF\0") + seg(0xDB, bytes([0]) + bytes([3] * 64)) + seg(0xC0, bytes([8, height >> 8, height & 255, width >> 8, width & 255, 1, 1, 0x11, 0]))
    out += table(0, 4, list(range(12))) + table(0x10, 8, symbols)
    if interval:
        out += seg(0xDD, bytes([0, interval]))
    return out + seg(0xDA, bytes([1, 1, 0, 0, 63, 0])) + scan + b"\xff\xd9"


@pytest.mark.parametrize("interval", [0, 1, 3])
def test_any_baseline_picture(interval):
    r = np.random.default_rng(1)
    blocks = r.integers(-90, 90, (6, 64)) * (r.random((6, 64)) < 0.2)
    raw = _plain_jpeg(blocks, 24, 16, interval)
    pic = jpeg_media.parse(raw)
    (coefs,) = jpeg_media.decode([pic])
    assert (coefs[:, 0] == blocks).all()
    thumb = jpeg_media.thumbnail(pic, coefs)
    assert thumb.shape == (2, 3)
    assert (thumb.reshape(-1) == np.clip((blocks[:, 0] * 3 + 4 >> 3) + 128, 0, 255)).all()


def test_broken_pictures():
    raw = jpeg_media.write_media(jpeg_media.padded(b"x"))
    for bad in (raw[2:], raw.replace(b"\xff\xc0", b"\xff\xc2")):
        with pytest.raises(ValueError):
            jpeg_media.parse(bad)


PAGES = "page_id long, url string, html string, digest string, response long, value string"


def test_warc_rows(spark):
    x = "x" * 1000
    given_ = [(1, "a b", x), (2, None, x), (3, "u", None), (4, "u", "\r\n\r\nWARC/1.1\r\n é"), (None, "z", x), (5, "", "y" * 999), (6, "k", "y" * 999), (7, "k", ""), (8, "k", "z" * 70_000)]
    rows = warc.warc_archive(spark.createDataFrame([(*g, "q", 0, "v") for g in given_], PAGES)).collect()
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows}
    assert len(rows) == len(given_)
    for page, _, html in given_:
        data = (html or "").encode()
        again = len(data) >= 1000 and data == x.encode() and page != 2
        assert got[page] == (len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", 2 if again else None)
    assert warc.warc_archive(spark.createDataFrame([], PAGES)).collect() == []


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.text(max_size=20), st.binary(max_size=300)), max_size=6), st.sampled_from([1, 2]))
def test_arc_and_warc_round_trips(items, version):
    records = [warc.ArcRecord(warc.arc_url(u), "0.0.0.0", "20200102030405", "text/html; charset=utf-8", p) for u, p in items]
    assert list(warc.read_arc(warc.write_arc(records, version))) == records
    raw = b"".join(warc.warc_record(r) for r in records)
    back = list(warc.read_warc(raw))
    assert [b for _, b in back] == [r.payload for r in records]
    for (head, _), r in zip(back, records):
        assert head["WARC-Date"] == "2020-01-02T03:04:05Z" and head["WARC-Target-URI"] == r.url
        assert head["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(r.payload).digest()).decode()


def served(body, head=b"HTTP/1.0 200 OK\r\nServer: s\r\n\r\n"):
    return head + body


def test_real_outputs(spark):
    from tidelog.llm.sentencepiece_bpe import sentencepiece_encode

    d, v = docs(spark), vocabulary()
    texts = sorted(t or "" for t in TEXTS)
    got = sentencepiece_encode(d, chunk=3).collect()
    assert sorted(tuple(r.ids) for r in got) == sorted(tuple(v.sp.encode(t)) for t in texts) and sorted(r.decoded for r in got) == sorted(v.sp.decode(v.sp.encode(t)) for t in texts)
    media = jpeg_media.media_files(d, chunk_bytes=2000).collect()
    back = jpeg_media.read_media([bytes(r.media) for r in media], at_once=1)
    assert sorted(p for p, _ in back) == sorted(jpeg_media.padded(t.encode()) for t in texts) and [f for _, f in back] == [r.feature for r in media]


def test_a_wrong_cut_is_found():
    v = MergeVocabulary(vocabulary().sp)
    texts = ["some text of words", "x"]
    v.check_whole(texts, v.encode_batch(texts))
    with pytest.raises(ValueError):
        v.check_whole(texts, [[1, 2], [3]])


def test_records_of_servers_and_others():
    r = warc.ArcRecord("http://a/", "1.2.3.4", "20010203040506", "text/html", served(b"HTTP/1.1 is\r\n\r\nthe text"))
    ((head, block),) = warc.read_warc(warc.warc_record(r))
    assert head["WARC-Type"] == "response" and block == r.payload and head["Content-Type"] == "application/http; msgtype=response"
    assert base64.b32decode(head["WARC-Payload-Digest"][5:]) == hashlib.sha1(b"HTTP/1.1 is\r\n\r\nthe text").digest()
    assert base64.b32decode(head["WARC-Block-Digest"][5:]) == hashlib.sha1(r.payload).digest()
    ((head, block),) = warc.read_warc(warc.warc_record(r, refers_to={"WARC-Refers-To": "<urn:uuid:x>"}))
    assert head["WARC-Type"] == "revisit" and block == served(b"") and head["WARC-Refers-To"] == "<urn:uuid:x>"
    ((head, block),) = warc.read_warc(warc.warc_record(r._replace(url="dns:a", content_type="text/dns", payload=b"1.2.3.4")))
    assert head["WARC-Type"] == "resource" and block == b"1.2.3.4" and head["Content-Type"] == "text/dns"


@pytest.mark.parametrize("piece", [7, 1000, 1 << 20])
def test_members_are_read_in_pieces(piece):
    r = random.Random(piece)
    records = [warc.ArcRecord(f"http://a/{i}", "0.0.0.0", "2001", "text/html", served(r.randbytes(r.choice([0, 1, 40, 5000, 70_000])))) for i in range(40)]
    raw = b"".join(warc.member(warc.warc_record(x)) + warc.EMPTY_MEMBER * (i % 3) for i, x in enumerate(records))
    got = list(warc.read_members(raw, max(piece, 100)))
    assert [h["WARC-Target-URI"] for h, *_ in got] == [x.url for x in records]
    assert [p for *_, p in got] == [hashlib.sha1(x.payload[len(served(b"")) :]).hexdigest() for x in records]
    assert [b for _, _, b, _ in got] == [hashlib.sha1(x.payload).hexdigest() for x in records]
    for bad in (raw[:-40], raw[: len(raw) // 2], raw[:-5]):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.read_members(bad))


def test_repeated_urls_have_ids_of_their_own(spark, tmp_path):
    import gzip

    text = "<p>some page</p>" * 100
    rows = [(i, f"http://h/{i % 2}", text if i % 3 else f"{text}{i}") for i in range(30)] + [(7, "http://h/1", text), (40, "http://h/0", "small"), (40, "http://h/0", "small"), (None, None, text)]
    path = str(tmp_path / "archives")
    got = warc.warc_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), path, chunk=2000, per_file=2).collect()
    assert len(got) == len(rows) == len({r.record_id for r in got})
    ids = {r.record_id: r for r in got}
    again = [r for r in got if r.record_type == "revisit"]
    assert again and all(ids[r.refers_to_record].page_id == r.refers_to == 29 and ids[r.refers_to_record].record_type == "response" for r in again)
    files = sorted(tmp_path.glob("archives/part-*"))
    assert len(files) > 3 and max(f.stat().st_size for f in files) < 10_000
    names = [h["WARC-Record-ID"] for f in files for h, _ in warc.read_warc(gzip.decompress(f.read_bytes()))]
    assert sorted(names) == sorted(ids)


def test_repeated_response_rows(spark):
    text = "y" * 2000
    got = warc.warc_archive(spark.createDataFrame([(5, "u", text), (5, "u", text), (2, "u", text)], "page_id long, url string, html string")).collect()
    assert len({r.record_id for r in got}) == 3
    assert sorted((r.page_id, r.record_type, r.refers_to, r.refers_to_record) for r in got) == [(2, "revisit", 5, None), (5, "response", None, None), (5, "response", None, None)]


def test_large_payloads(spark):
    """200 MB in all, through batches of a few members."""
    big = spark.range(40).select(F.col("id").alias("page_id"), F.lit("http://big/").alias("url"), F.concat(F.repeat(F.lit("0123456789 abcdefghijklm "), 200_000), F.col("id").cast("string")).alias("html"))
    got = warc.warc_archive(big).collect()
    assert sum(r.payload_bytes for r in got) > 190_000_000 and {r.record_type for r in got} == {"response"} and len({r.payload_digest for r in got}) == 40


@pytest.mark.parametrize("version,packed", [(1, False), (2, False), (1, True), (2, True)])
def test_legacy_archives_are_converted(spark, tmp_path, version, packed):
    import gzip

    records = [warc.ArcRecord(f"http://a/{i}", "1.2.3.4", "20010203040506", "text/html; charset=x", served(b"x" * i)) for i in range(9)]
    raw = warc.write_arc(records, version)
    if packed:  # a member each for the version block and every record
        ends = [len(warc.write_arc(records[:k], version)) for k in range(len(records) + 1)]
        raw = b"".join(gzip.compress(raw[a:b]) for a, b in zip([0, *ends], ends))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "old.arc").write_bytes(raw)
    rows = warc.convert_archives(spark, str(tmp_path / "in"), str(tmp_path / "out")).collect()
    assert sorted((r.target_uri, r.payload_bytes, r.payload_digest, r.record_type, r.warc_date) for r in rows) == [
        (x.url, i, hashlib.sha1(b"x" * i).hexdigest(), "response", "2001-02-03T04:05:06Z") for i, x in enumerate(records)
    ]


def test_broken_archives():
    good = warc.write_arc([warc.ArcRecord("u", "0.0.0.0", "2020", "text/html", b"abc")], 2)
    for bad in (good[:-3], good.replace(b"filedesc", b"xiledesc"), good.replace(b"abc", b"abd")):
        with pytest.raises(ValueError):
            list(warc.read_arc(bad))


def test_licence_tables():
    table = license_rules.known()
    assert set(table.values()) == set(license_rules.SENTENCES) and max(len(k.split()) for k in table) < 96
    assert len({name for name, _ in license_rules.RULES}) > 30
    assert {i for _, seq in license_rules.RULES for i in seq} <= set(license_rules.SENTENCES)


def test_licences(spark):
    s = {k: forms[0] for k, forms in license_rules.SENTENCES.items()}
    texts = [f"Intro.\n{s['m3']}.\nMore text. {s['m4']}.", f"{s['m3']}; {s['a1'].upper()}.", s["b1"] + ".\n" + s["b2"] + ".", "licence of nothing", None, "", s["c1"] + "  \n" + s["c1"], LONG + "\n" + s["g1"] + "."]
    rows = {r.doc_id: r for r in license_scan(spark.createDataFrame([(i, t, "x", "y", 1, 7, "x", "y", 5, 6, 8, 9) for i, t in enumerate(texts)], DOCS)).collect()}
    assert [rows[i].licences for i in range(8)] == ["MIT", "Apache-2.0,MIT", "BSD-2-Clause", "", "", "", "CC-BY-NC-4.0", "GPL-3.0"]
    assert [rows[i].licence for i in range(8)] == ["MIT", "Apache-2.0", "BSD-2-Clause", None, None, None, "CC-BY-NC-4.0", "GPL-3.0"]
    assert rows[0].sentence_ids == "m3 m4" and rows[6].n_sentences == 2
    assert license_scan(docs(spark).limit(0)).collect() == []


#: Notices as they are distributed.
NOTICES = {
    "MIT": """Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.""",
    "BSD-2-Clause": """Copyright (c) 2020, Someone

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED.""",
    "BSD-3-Clause": """Copyright (c) 2020, Someone

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED.""",
    "BSD-4-Clause": """Copyright (c) 2020, Someone

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. All advertising materials mentioning features or use of this software must
   display the following acknowledgement:
   This product includes software developed by the organization.

4. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from this
   software without specific prior written permission.
""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.""",
    "GPL-2.0-or-later": """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License along
with this program; if not, write to the Free Software Foundation, Inc.,
51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.""",
    "GPL-2.0-only": """This program is free software; you can redistribute it and/or modify it
under the terms and conditions of the GNU General Public License,
version 2, as published by the Free Software Foundation.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.""",
    "GPL-2.0": """                    GNU GENERAL PUBLIC LICENSE
                       Version 2, June 1991

 Copyright (C) 1989, 1991 Free Software Foundation, Inc.
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.""",
    "GPL-3.0": """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.""",
    "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details.""",
    "LGPL-2.1": """                  GNU LESSER GENERAL PUBLIC LICENSE
                       Version 2.1, February 1999
""",
    "AGPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as published
by the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
    "Zlib": """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:""",
    "BSL-1.0": """Boost Software License - Version 1.0 - August 17th, 2003
""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.""",
    "EPL-2.0": """This program and the accompanying materials are made available under the
terms of the Eclipse Public License 2.0 which is available at
https://www.eclipse.org/legal/epl-2.0""",
}


@pytest.mark.parametrize("leader,end", [("", "\n"), ("# ", "\n"), (" * ", "\r\n"), ("// ", "\n"), (";; ", "\n"), ("", " ")])
def test_wrapped_notices(spark, leader, end):
    texts = ["Code.\n\n" + end.join((leader + line).rstrip() for line in t.split("\n")) + end + leader.rstrip() + end + leader + "more" for t in NOTICES.values()]
    if end == " ":  # a line a paragraph
        texts = ["\n\n".join(" ".join(x.split()) for x in t.split("\n\n")) for t in NOTICES.values()]
    rows = license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {list(NOTICES)[r.doc_id]: r.licence for r in rows} == {k: k for k in NOTICES}


def test_licences_as_the_sql_has_them(spark):
    import duckdb

    r = random.Random(6)
    lines = [f for forms in license_rules.SENTENCES.values() for f in forms]
    texts: list = [None, "", "licence", "\n\n", "a) permi. b"]
    for t in NOTICES.values():
        words = t.split()
        cut = sorted(r.sample(range(len(words)), min(len(words), 6)))
        texts += [t, "# " + t.replace("\n", "\n# "), "\n".join(" ".join(words[a:b]) for a, b in zip([0, *cut], [*cut, None]))]
    for _ in range(60):
        chosen = [r.choice(lines) for _ in range(4)]
        texts.append("".join(s + r.choice([".\n", "\n", "; ", "\r\n\r\n", "!\t", ".\n1. ", "\n * ", " "]) for s in chosen))
    rows = [(i, t) for i, t in enumerate(texts)]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    from tidelog.llm.oracles import license_sql

    want = sorted(con.execute(f"select doc_id, n_sentences, sentence_ids, licences, licence from ({license_sql()})").fetchall())
    assert sorted(tuple(x) for x in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == want


def test_blank_lines_end_sentences(spark):
    texts = ["Licensed under\n\nCC BY 4.0", "Licensed under\n # \n# CC BY 4.0", "Licensed under\n# CC BY 4.0", "Not Licensed under\nCC BY 4.0"]
    rows = license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r.licence for r in sorted(rows)] == [None, None, "CC-BY-4.0", None]


def test_registered(spark, sf):
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(queries.queries())
