"""Training-data operators against brute force on small tables with odd rows."""

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from haplomesh.llm import bpe, exact_dedup, license_scan, mpegts, ngram_join, packing, pii, suffix_dedup, token_codes, toxicity
from haplomesh.llm.common import new_folder
from haplomesh.llm.components import connected_components
from haplomesh.llm.queries import queries
from haplomesh.llm.vocabulary import CachedTokenizer, default_path

SCHEMA = "doc_id long, text string, fp string, kept int"  # two extra columns with clashing names


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    body = [sentence(rng, rng.randint(1, 150)) for _ in range(40)]
    passage = sentence(rng, 60)
    rows = [(i, t) for i, t in enumerate(body)]
    rows += [(100, body[3]), (101, body[3] + "  "), (102, " ".join(body[3])), (103, None), (104, ""), (105, " \n\t"), (106, body[20][:-1] + "x")]
    rows += [(110 + k, sentence(rng, 20) + " " + passage + " " + sentence(rng, 20)) for k in range(4)]
    rows += [(120, sentence(rng, 30_000)), (121, "a" * 50_000), (None, body[5]), (130, body[6]), (130, body[6])]
    return rows


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def bare(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(docs, rows, weak):
    poly = exact_dedup.Polynomial(primes=(3, 5), bases=(2, 2)) if weak else None  # small primes collide
    got = exact_dedup.exact_dedup(docs, poly).collect()
    groups = defaultdict(list)
    for d, t in rows:
        groups[bare(t)].append((-len(t or ""), d is None, d))
    want = sorted((d, min(groups[bare(t)])[2], len(groups[bare(t)]), d == min(groups[bare(t)])[2], hashlib.sha256(bare(t).encode()).hexdigest()) for d, t in rows if d is not None)
    assert sorted(tuple(r) for r in got if r.doc_id is not None) == want and len(got) == len(rows)


def test_fingerprints_compose():
    p = exact_dedup.Polynomial(chunk=16)
    data = bytes(range(256)) * 3
    for cut in (0, 1, 15, 16, 17, 500, len(data)):
        assert p.combine(p.of(data[:cut]), p.of(data[cut:]), len(data) - cut) == p.of(data)
    assert exact_dedup.same_text("a b" * 50_000, "ab" * 50_000) and not exact_dedup.same_text("ab", "abc")


def test_token_codes_round_trip(spark, docs, rows):
    tok = CachedTokenizer(default_path("byte_bpe_50k.json"))
    path = new_folder(spark, "t")
    token_codes.write_tokens(docs, path, default_path("byte_bpe_50k.json"), 2, file_tokens=5000)
    got = token_codes.read_tokens(spark, path, with_ids=True).collect()
    want = defaultdict(list)
    for d, t in rows:
        want[d].append([*tok.tok.encode(t or "", add_special_tokens=False).ids, 2])
    before = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == before and r.ids in want[r.doc_id]
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        before += r.n_tokens
    known = [r.doc_id for r in sorted(got, key=lambda r: r.start) if r.doc_id is not None]
    assert known == sorted(known) and len(got) == len(rows)


def test_dac_random_access():
    rng = np.random.default_rng(1)
    ids = rng.choice([3, 200, 300, 50_000, 70_000, 2**31], 3000).astype(np.uint32)
    f = token_codes.DacFile(token_codes.dac_file([1, None], np.array([0, 10, 3000]), ids))
    assert all(f.token(i) == ids[i] for i in range(0, 3000, 7)) and (f.tokens(511, 1700) == ids[511:1700]).all()
    with pytest.raises(IndexError):
        f.token(3000)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cached_tokenizer_equals_library(name):
    tok, rng = CachedTokenizer(default_path(name), most=50), random.Random(2)
    for _ in range(1500):
        t = "".join(rng.choice("aB é.,'\n\t 1 sßñİΣ中<|\x1c") for _ in range(rng.randint(0, 30)))
        assert tok.encode(t) == tok.full(t), repr(t)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_column_encoding_equals_library(name):
    tok, rng = CachedTokenizer(default_path(name), most=50), random.Random(3)
    parts = ["Haus", "straße", "the", "µÀ", "a\nb", "x,\ny.", "\nz", "w\n", "it's", "12", "!?", "中", "Σίς", "", "", "<|endoftext|>", "\x1c", "é\n\né", "word" * 40]
    texts = ["", " ", "\n", "a", *(" ".join(rng.choices(parts[: rng.choice([6, 13, len(parts)])], k=rng.randint(0, 12))) for _ in range(1500))]
    texts += ["".join(rng.choice("aB é.,'\n\t 1 sßñİΣ中<|\x1c") for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    for lo in (0, 3):  # a slice begins inside its buffer
        for end in (None, 7):
            ids, first = tok.encode_column(pa.array(texts)[lo:], end)
            assert len(first) == len(texts) - lo + 1 and first[-1] == len(ids)
            for k, t in enumerate(texts[lo:]):
                assert ids[first[k] : first[k + 1]].tolist() == tok.tok.encode(t, add_special_tokens=False).ids + [7] * (end is not None), repr(t)
    ids, first = tok.encode_column(pa.array([], pa.string()), 7)
    assert len(ids) == 0 and first.tolist() == [0]


def test_bpe_equals_tiktoken(docs, rows):
    import base64

    import tiktoken

    path = default_path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    enc = bpe.encode_documents(docs, path, public_tokenizers.PATTERN)
    back = {r.doc_id: bytes(r.decoded) for r in bpe.decode_documents(enc, path, public_tokenizers.PATTERN).collect()}
    got = {r.doc_id: r.ids for r in enc.collect()}
    for d, t in rows:
        assert got[d] == ref.encode_ordinary(t or "") and back[d] == (t or "").encode()


def check_packing(out, ids, limit=2048, segments=64):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
        assert any(zlib.crc32(np.array(i[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 and len(i) == r.doc_tokens for i in ids[r.doc_id])
    for d, pieces in by_doc.items():
        assert sum(p.length for p in pieces) == sum(map(len, ids[d]))
    pad = 0
    for pieces in by_seq.values():
        pieces.sort(key=lambda p: p.offset)
        assert [p.offset for p in pieces] == np.cumsum([0] + [p.length for p in pieces[:-1]]).tolist() and len(pieces) <= segments
        n = sum(p.length for p in pieces)
        assert n <= limit
        pad += 0 if n & (n - 1) == 0 else limit - n
    return pad


def test_packing(docs, rows):
    tok = CachedTokenizer(default_path("word_bpe_49k.json"))
    ids = defaultdict(list)
    for d, t in rows:
        ids[d].append([*tok.tok.encode(t or "", add_special_tokens=False).ids, 1])
    out = packing.pack_documents(docs, default_path("word_bpe_49k.json")).collect()
    assert check_packing(out, ids) == 0
    assert {r.doc_id for r in out} == {d for d, _ in rows}


def test_packing_limits():
    rng = random.Random(3)
    p = packing.Packer(tokens=64, segments=3, loss=20, window=16)
    out = []
    for k in range(200):
        n = rng.randint(1, 90)
        mask = bytes(rng.random() < 0.4 for _ in range(n))
        out += p.add(packing.Piece(k, 0, np.arange(n, dtype="<u4").tobytes(), n, mask))
    out += p.finish()
    seqs = defaultdict(list)
    for r in out:
        seqs[r[5]].append(r)
    assert all(sum(r[2] for r in s) <= 64 and len(s) <= 3 and sum(r[7] for r in s) <= 20 for s in seqs.values())


def test_packing_of_turns_under_a_loss_limit(spark):
    """Turns of conversations as rows: the assistant's ids bear loss, the user's none."""
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").coalesce(2)
    turns = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text", (F.col("role") == "assistant").alias("bears"))
    texts = {r.doc_id: (r.text or "", r.bears) for r in turns.collect()}
    tok = CachedTokenizer(default_path("word_bpe_49k.json"))
    size = {d: len(tok.tok.encode(t, add_special_tokens=False).ids) + 1 for d, (t, _) in texts.items()}
    out = packing.pack_documents(turns, default_path("word_bpe_49k.json"), tokens=512, segments=16, loss=128, loss_col="bears").collect()
    length, loss, count = defaultdict(int), defaultdict(int), defaultdict(int)
    held = defaultdict(int)
    for r in out:
        length[r.sequence_id] += r.length
        loss[r.sequence_id] += r.loss_tokens
        count[r.sequence_id] += 1
        held[r.doc_id] += r.length
        assert r.loss_tokens == (r.length if texts[r.doc_id][1] else 0)
    assert held == size and len({b for _, b in texts.values()}) == 2
    assert max(length.values()) <= 512 and max(loss.values()) <= 128 and max(count.values()) <= 16


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(x - 9 * (x > 9) for x in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0


def brute_pii(t):
    out = []
    for rank, (k, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m.group())
            if k == "ip" and any(int(x) > 255 for x in m.group().split(".")) or k == "card" and not (12 <= len(d) <= 19 and luhn(d)) or k == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), rank, m.end(), k))
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out)).encode()).hexdigest()


def test_pii(spark, docs):
    rng = random.Random(5)
    texts = ["", None, "a@b.c_x@d.e", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "+1 (386) 555-3733", "0001.002.3.255", "9" * 20_000, "a" * 20_000, "é😀 a@b.co\x01x", "a@b.co 1.2.3.4 " * 5_000]
    texts += ["".join(rng.choice("ab@..-+ 0123456789()_%é\x01") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.pii_report(df).collect():
        assert r.base_sha256 == brute_pii(texts[r.doc_id] or ""), texts[r.doc_id]
    more = spark.createDataFrame([(1, "IBAN DE89 3704 0044 0532 0130 00 at the bank"), (2, "IBAN DE88 3704 0044 0532 0130 00"), (3, "ssn 123-45-6789"), (4, "number 123-45-6789")], "doc_id long, text string")
    assert {r.doc_id: r.spans for r in pii.pii_report(more).collect()} == {1: "iban:5:32", 2: "", 3: "ssn:4:15", 4: ""}
    red = pii.redact(spark.createDataFrame([(1, "mail a@b.co now", "k"), (2, None, "k")], "doc_id long, text string, _x string"))
    assert {r.doc_id: r.text for r in red.collect()} == {1: "mail [EMAIL] now", 2: None} and red.columns == ["doc_id", "text", "_x"]
    assert pii.redact(docs).columns == docs.columns


def test_transport_stream(docs, rows):
    for n in (0, 1, 5, 157, 158, 159, 184, 341, 342, 343, 18_399, 18_400, 18_401, 60_000):
        p = bytes(k % 251 for k in range(n))
        s = mpegts.demux(mpegts.mux(p))
        assert s.payload == p and len(s.stamps) == len(s.access) == -(-n // mpegts.PES_BYTES)
    media = mpegts.mux(bytes(5000))
    with pytest.raises(mpegts.StreamError):
        mpegts.demux(media[: 188 * 6] + media[188 * 7 :])  # a lost packet
    assert mpegts.demux(media[: 188 * 6] + media[188 * 5 : 188 * 6] + media[188 * 6 :]).payload == bytes(5000)  # a repeated one
    got = mpegts.read_media(mpegts.store_media(docs)).collect()
    want = {}
    for d, t in rows:
        b = (t or "").encode()
        want[d] = b + b" " * (max(192, -(-len(b) // 192) * 192) - len(b))
    assert len(got) == len(rows)
    for r in got:
        assert r.payload_sha256 == hashlib.sha256(want[r.doc_id]).hexdigest() and r.payload_bytes == len(want[r.doc_id]) and r.tail_crc32 == zlib.crc32(want[r.doc_id][-16:])


def brute_secrets(t):
    """The secret spans of ``t`` by a loop: a window of 40 characters each side decides where context is asked for."""
    block = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----\s*(?:Proc-Type: [^\n]*\n)?(?:DEK-Info: [^\n]*\n)?[^-]*-----END [A-Z ]{0,40}PRIVATE KEY-----"
    words = "api|key|token|secret|password|passwd|pwd|credentials?|bearer|passwort|schlüssel|jeton|clave|contraseña"
    out = []
    for m in re.finditer(rf"{block}|(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{{20,}}", t):
        s = m.group()
        known = re.match(r"-----BEGIN |AKIA[0-9A-Z]{16}$|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-|sk_live_", s)
        turns = sum(x.isdigit() and y.isalpha() or x.isalpha() and y.isdigit() for x, y in itertools.pairwise(s))
        near = t[max(0, m.start() - 40) : m.end() + 40]
        if known or turns >= 3 and re.search(rf"(?i)(?<![a-z])(?:{words})(?![a-z])", near):
            out.append(f"secret:{m.start()}:{m.end()}")
    return out


def test_secrets_need_context_or_a_known_issuer(spark):
    rng = random.Random(9)
    hexa = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(8)]
    pem = "-----BEGIN RSA PRIVATE KEY-----\nMIIBOgIBAAJBAK\n+/a=\n-----END RSA PRIVATE KEY-----"
    texts = [
        None, "", f'é token = "{hexa[0]}" x', f"commit {hexa[1]} of the tree", f"AKIA{'ABCD2345' * 2} here", f"so {pem} ends", "-" * 200, "token " + "a" * 400, "key = " + "9" * 50_000,
        f"api_key={hexa[2]} and api_key={hexa[3]}", f"password: {hexa[4]}" + " word" * 20 + f" {hexa[5]}", "keyboard " + hexa[6], f"{hexa[7]} {hexa[7]} ist der Schlüssel", "secret/" + "ab1" * 60_000,
    ]
    texts += [" ".join(rng.choice([*hexa, "token", "word", "key:", "monkey", "ghp_" + "aB3" * 12, "é"]) for _ in range(rng.randint(2, 9))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.pii_report(df).collect():
        got = [x for x in r.spans.split(",") if x.startswith("secret")]
        assert got == brute_secrets(texts[r.doc_id] or ""), texts[r.doc_id]
        assert r.n_secret == len(got) and all(0.6 <= float(x) <= 1 for x in r.scores.split(",") if x)
        assert len(r.scores.split(",")) == len(r.spans.split(","))
    red = pii.redact(df.filter("doc_id IN (2, 5)")).orderBy("doc_id").collect()
    assert [r.text for r in red] == ['é token = "[SECRET]" x', "so [SECRET] ends"]


def test_context_raises_the_score_of_base_spans(spark):
    df = spark.createDataFrame([(1, "card 4111 1111 1111 1111"), (2, "thing 4111 1111 1111 1111")], "doc_id long, text string")
    scores = {r.doc_id: float(r.scores) for r in pii.pii_report(df).collect()}
    assert scores[1] > scores[2] >= 0.6


def brute_license(text):
    """Names found by a search over the sentences' identifiers: each rule, in order, as a regular expression over a row of marks."""
    known = license_scan.identify(text)
    names = sorted({n for n in (k[1] for k in known)} | {n for _, rule in license_scan.RULES for n in rule})
    sign = {n: chr(0x4E00 + i) for i, n in enumerate(names)}
    row, found = "".join(sign[k[1]] for k in known), []
    gone, gap = "\uffff", license_scan.GAP + 1
    for licence, rule in license_scan.RULES:
        at = 0
        pattern = re.compile(f"{gone}*".join(sign[n] for n in rule))
        while m := pattern.search(row, at):
            took = [i for i in range(*m.span()) if row[i] != gone]
            if all(known[b][0] - known[a][0] <= gap for a, b in itertools.pairwise(took)):
                found.append(licence.format(v=next((known[i][2] for i in took if known[i][2]), "")))
                row = "".join(gone if i in took else c for i, c in enumerate(row))
                at = m.end()
            else:
                at = m.start() + 1
    return sorted(found + [f"{known[i][1]}?" for i, c in enumerate(row) if c != gone])


def test_license_query_against_a_brute_force_version(spark):
    """The registered query over the whole smallest table, and licence texts cut and shuffled by sentence."""
    base = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{base}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries()["op2_license_scan"](spark, base).collect()}
    assert got.keys() == texts.keys() and any(r.n_notices for r in got.values())
    for d, t in texts.items():
        names = [x.rsplit(":", 2)[0] for x in got[d].spans.split(",") if x]
        assert sorted(names) == brute_license(t) and got[d].n_notices == len(names) and got[d].licenses == ",".join(sorted(set(names)))
    rng = random.Random(4)
    parts = [s for t, _ in WHOLE for _, _, s in license_scan.sentences(t)]
    for _ in range(300):
        t = "\n\n".join(rng.choice(parts) if rng.random() < 0.5 else x for x in rng.choice([[s for _, _, s in license_scan.sentences(w)] for w, _ in WHOLE]) * rng.randint(1, 3))
        assert sorted(n for n, _, _ in license_scan.scan(t)) == brute_license(t), t


def test_iban_before_capitals_and_digits(spark):
    de, gb = "DE89370400440532013000", "GB82WEST12345698765432"
    spaced = "DE89 3704 0044 0532 0130 00"
    cases = [
        (f"{de} Please", [de]), (f"IBAN {spaced} BIC COBADEFF", [spaced]), (f"{gb} 2024", [gb]), (f"{de} {gb} A", [de, gb]),
        (f"AT12 {spaced} BIC", [spaced]), (f"é {spaced} {spaced}1 {gb}", [spaced, gb]), (f"{de}0", []), ("DE88370400440532013000 Please", []),
    ]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.pii_report(df).collect()}
    for k, (t, want) in enumerate(cases):
        spans = [x.split(":") for x in got[k].split(",") if x.startswith("iban")]
        assert [t[int(a) : int(b)] for _, a, b in spans] == want, t
    assert [r.text for r in pii.redact(df.filter("doc_id = 3")).collect()] == ["[IBAN] [IBAN] A"]


def test_license_rules():
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction. Something else here. The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED."
    assert [n for n, _, _ in license_scan.scan("Intro.\n" + mit)] == ["MIT"]
    assert [n for n, _, _ in license_scan.scan("Licensed under the Apache License, Version 2.0. Text. Licensed under CC BY-NC 4.0.")] == ["Apache-2.0", "CC-BY-NC-4.0"]
    assert [n for n, _, _ in license_scan.scan("This work is licensed under the GNU General Public License, version 3.")] == ["GPL-3"]
    assert [n for n, _, _ in license_scan.scan("Copyright 2020 A. B.\nAll rights reserved.")] == ["proprietary"]
    assert license_scan.scan("A license to thrill.") == [] and license_scan.scan("") == []


MIT = """The MIT License (MIT)

Copyright (c) 2020 A. B.

Permission is hereby granted, free of charge, to any person obtaining a copy of
this software and associated documentation files (the "Software"), to deal in
the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of
the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS
FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER
IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
GPL2 = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
GPL3 = GPL2.replace("software; you", "software: you").replace("Foundation; either version 2", "Foundation, either version 3")
BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD3 = BSD2.replace("\n\nTHIS", """

3. Neither the name of Some Holder Inc. nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS""")
WHOLE = [(MIT, "MIT"), (APACHE, "Apache-2.0"), (GPL2, "GPL-2-or-later"), (GPL3, "GPL-3-or-later"), (GPL3.replace("GNU General", "GNU Lesser General"), "LGPL-3-or-later"), (BSD2, "BSD-2-Clause"), (BSD3, "BSD-3-Clause")]


@pytest.mark.parametrize("text, licence", WHOLE)
def test_whole_licence_texts(text, licence):
    body = text[text.index("Permission") :] if licence == "MIT" else text
    for t in (body, "\n".join("# " + x for x in body.split("\n")).replace("# \n", "#\n"), " ".join(body.split()), body.replace("\n\n", "\n")):
        got = license_scan.scan(t)
        assert [n for n, _, _ in got] == [licence], t
        assert got[0][2] >= len(t.rstrip()) - 1
    assert [n for n, _, _ in license_scan.scan("Intro.\n\n" + text + "\n\nMore.") if n != "copyright?"] == [licence]


def toks(t):
    return (t or "").split()


def test_suffix_dedup(docs, rows):
    some = [(d, t) for d, t in rows if d is not None]
    where = defaultdict(list)
    for k, (d, t) in enumerate(some):
        for p in range(len(toks(t)) - 49):
            where[tuple(toks(t)[p : p + 50])].append((d, p))
    want = defaultdict(set)
    for v in where.values():
        for d, p in v if len(v) > 1 else ():
            want[d].update(range(p, p + 50))
    got = defaultdict(set)
    for r in suffix_dedup.suffix_dedup(docs).collect():
        got[r.doc_id].update(range(r.start, r.start + r.length))
    assert got == want and 110 in got


def test_suffix_dedup_of_repeats_that_reach_to_the_left(spark):
    rng = random.Random(3)
    plate = sentence(rng, 34)  # in every document; pairs also share the 16 words before it
    pairs = [sentence(rng, 16) for _ in range(50)]
    ids = rng.sample(range(300), 300)
    before = {d: pairs[k // 2] if k < 100 else sentence(rng, 16) for k, d in enumerate(ids)}
    table = [(d, f"{sentence(rng, 30)} {before[d]} {plate} {sentence(rng, 60)}") for d in range(300)]
    found = suffix_dedup.suffix_dedup(spark.createDataFrame(table, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.start, r.length) for r in found} == {(d, 30, 50) for d in ids[:100]}


def shingles(t):
    w = re.findall(r"\w+", (t or "").lower())
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near_rows(n=150):
    rng = random.Random(11)
    base = sentence(rng, 200).split()
    out = []
    for k in range(n):  # one large group of near copies, all different
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = sentence(rng, 1)
        out.append((1000 + k, " ".join(w)))
    return out


def test_ngram_join(spark, rows):
    some = [(d, t) for d, t in rows if d is not None] + near_rows()
    sets = [shingles(t) for _, t in some]
    links, root = [0] * len(some), list(range(len(some)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9:
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    group = defaultdict(list)
    for i in range(len(some)):
        group[find(i)].append(some[i][0])
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in some] + [(None, "x y z", "x", 1)], SCHEMA)
    got = ngram_join.ngram_join(df, tile=16).collect()
    want = sorted((some[i][0], links[i], min(group[find(i)])) for i in range(len(some)))
    assert sorted((r.doc_id, r.n_links, r.group_id) for r in got if r.doc_id is not None) == want and len(got) == len(some) + 1


def test_band_plan_meets_recall():
    bands, rows = ngram_join.band_plan(0.8, 0.999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(40)] + [(5000, k) for k in range(5001, 5100)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        return x if root[x] == x else find(root[x])

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in root}


def test_toxicity_grammar():
    s = toxicity.Scorer(toxicity.Lexicon({"blorg": 2.0}, {"quux*": 1.0}))
    plain, aimed, denied, said = (s.score(t) for t in ("a blorg here.", "you are a blorg.", "not a blorg.", "he said a blorg."))
    assert aimed > plain > denied and plain > said and s.score("") == pytest.approx(toxicity.BASE)
    assert s.score("I will kill you") > s.score("kill time") == pytest.approx(toxicity.BASE)
    once, twice, far = (s.score(t) for t in ("a quuxel here.", "a quuxel here. some quuxen there.", "a quuxel here. some quuxen there. " + "other words follow. " * 1000))
    assert once < toxicity.THRESHOLD < twice and far == pytest.approx(toxicity.BASE)
    assert s.score("They beat them. He kill it. " + "A long and harmless text. " * 200) == pytest.approx(toxicity.BASE)


def test_composed_grammar_equals_its_paths():
    """Every sequence of five classes, against the rules written out: the sum of what each pattern adds on its own path."""
    insults = (toxicity.INSULT, toxicity.WEAK)

    def brute(kinds):
        total = 0.0
        named = aimed = None  # what the target pattern has seen first
        threat = denied = said = False
        for k in kinds:
            if aimed is None and named is None and (k == toxicity.TARGET or k in insults):
                aimed, named = k == toxicity.TARGET, k in insults
                open_ = True
            elif (aimed or named) and open_ and (aimed and k in insults or named and k == toxicity.TARGET):
                total, open_ = total + toxicity.ARCS["target"], False
            if k == toxicity.THREAT and threat is False:
                threat = True
            elif k == toxicity.TARGET and threat is True:
                total, threat = total + toxicity.ARCS["threat"], None
            if denied and k in (*insults, toxicity.THREAT):
                total, denied = total + toxicity.ARCS["negation"], False
            elif k == toxicity.NEGATION:
                denied = True
            if said and k in (*insults, toxicity.THREAT):
                total += toxicity.ARCS["report"]
            said |= k == toxicity.REPORT
        return total

    machine = toxicity.grammar()
    for kinds in itertools.product(range(7), repeat=5):
        state, total = 0, 0.0
        for k in kinds:
            state, gain = machine.step(state, k)
            total += gain
        assert total == pytest.approx(brute(kinds)), kinds


def test_learned_entries_are_pruned():
    rows = [("disg*", 50, 0, 60, 0), ("disgu*", 50, 0, 60, 0), ("disgust", 40, 0, 50, 0), ("mild*", 30, 30, 90, 40), ("milder", 10, 9, 30, 12), ("rare", 8, 0, 8, 0)]
    got = toxicity.learned_lexicon(rows, (100, 800, 10_000, 100_000))
    assert set(got.strong) == {"disg*", "rare"} and set(got.weak) == {"mild*"} and got.cost > toxicity.COST


def test_toxicity_query_against_a_brute_force_version(spark):
    """Scores of the whole query, against a scorer that walks the patterns one by one."""
    base = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    learned = toxicity.fit(docs, labels)
    slow = toxicity.Scorer(learned)
    fixed = {w: k for k, ws in toxicity.WORDS.items() for w in ws.split()}
    entries = learned.strong | learned.weak

    def classed(word):
        if word in toxicity.INSULTS.split():
            return toxicity.INSULT, toxicity.INSULT_WEIGHT
        for name in (word, *(f"{word[:n]}*" for n in range(len(word), 0, -1))):
            if name in fixed and name == word and word not in entries:
                return fixed[word], 0.0
            if name in entries:
                return (toxicity.INSULT if name in learned.strong else toxicity.WEAK), entries[name]
        return toxicity.OTHER, 0.0

    def score(text):
        clean, density = 1 - toxicity.BASE, 0.0
        for clause in re.split(r"[.!?;:\n]", text.lower()):
            words = re.findall(r"\w+", clause)
            kinds = [classed(w) for w in words]
            state, arcs, threat = 0, 0.0, False
            for k, _ in kinds:
                if k != toxicity.OTHER:
                    state, gain = slow.machine.step(state, k)
                    arcs += gain
                    threat |= k == toxicity.TARGET and gain >= toxicity.ARCS["threat"]
            strong = max((w for k, w in kinds if k == toxicity.INSULT), default=0)
            weak = sum(w for k, w in kinds if k == toxicity.WEAK)
            value = max(strong, weak) + arcs if strong or weak or threat else 0
            density -= learned.cost * len(words)
            if strong:
                clean *= 1 - 1 / (1 + math.exp(2 - value))
            else:
                density += value
        return 1 - clean * (1 - 1 / (1 + math.exp(2 - density)) if density > 0 else 1)

    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = toxicity.toxicity(spark, docs, labels).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.score == pytest.approx(score(texts[r.doc_id]), abs=1e-7) and r.predicted == (r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_toxicity_held_out(spark):
    base = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    got = toxicity.toxicity(spark, docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert got.predicted[got.toxic == 1].mean() > 0.9 and got.predicted[got.toxic == 0].mean() < 0.02
    one = docs.limit(1).select("doc_id").head()[0]
    assert toxicity.toxicity(spark, docs.limit(20), labels.filter("false")).count() == 20 and isinstance(one, int)


@pytest.mark.parametrize("f", [exact_dedup.exact_dedup, exact_dedup.keep_first, license_scan.license_scan, suffix_dedup.suffix_dedup, ngram_join.ngram_join, ngram_join.keep_one, pii.pii_report, pii.redact])
def test_empty_table(empty, f):
    assert f(empty).count() == 0


def test_empty_table_files(spark, empty):
    assert token_codes.tokens_to_files(empty, default_path("byte_bpe_50k.json"), 2).count() == 0
    assert packing.pack_documents(empty, default_path("word_bpe_49k.json")).count() == 0
    assert mpegts.read_media(mpegts.store_media(empty)).count() == 0
    assert bpe.round_trip(empty, default_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    assert toxicity.toxicity(spark, empty, labels).count() == 0 and toxicity.toxicity(spark, empty, labels.filter("false")).count() == 0
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


ODD = "doc_id long, text string, lang string, source string, n_chars long, _keep_id long, _pii int, _row string, _mark long, score double"


def test_pipeline_stages(spark, rows):
    pipeline = pytest.importorskip("corpus_pipeline")
    near = near_rows(12)
    table = [(d, t) for d, t in rows + near] + [(900, "you idiot. you moron"), (5000, "you idiot. you moron"), (5000, "a kind text"), (None, "you idiot. you moron")]
    table += [(5001, "same words"), (5002, "other words"), (5002, "same  words"), (5003, near[0][1] + " end"), (5003, "a text of its own")]
    docs = spark.createDataFrame([(d, t, "en", "s", 1, 2, 3, "x", 4, 0.5) for d, t in table], ODD)
    base = "/root/testdata/sf0.001"
    clean = pipeline.drop_toxic(spark, docs, base)
    toxic = [r for r in table if r[1] == "you idiot. you moron"]
    assert sorted(map(repr, clean.select("doc_id", "text").collect())) == sorted(repr(r) for r in docs.select("doc_id", "text").collect() if (r.doc_id, r.text) not in toxic)
    single = pipeline.drop_copies(spark, clean, base)
    groups = defaultdict(list)
    for d, t in table:
        if (d, t) not in toxic:
            groups[bare(t)].append((-len(t or ""), d is None, d))
    assert sorted((bare(r.text), r.doc_id) for r in single.collect()) == sorted((t, min(g)[2]) for t, g in groups.items())
    far = pipeline.drop_near_copies(spark, single, base)
    left = [(r.doc_id, r.text) for r in far.collect()]
    assert sum(t in {x for _, x in near} | {near[0][1] + " end"} for _, t in left) == 1 and (5003, "a text of its own") in left
    red = pipeline.redact_pii(spark, far, base)
    assert red.count() == far.count() and red.filter("n_chars <> length(coalesce(text, ''))").isEmpty()
    for stage in (clean, single, far, red):
        assert stage.dtypes == docs.dtypes
        assert stage.filter("_keep_id <> 2 OR _pii <> 3 OR _row <> 'x' OR _mark <> 4 OR score <> 0.5").isEmpty()
    assert {r.doc_id for r in pipeline.pack(spark, red, base).collect()} == {r.doc_id for r in red.collect()}
    assert [n.split("_")[0] for n in queries()] == [f"op{n}" for n in range(1, 11)]


def test_pipeline_of_empty_tables(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.createDataFrame([], ODD)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, "/root/testdata/sf0.001").count() == 0


def test_pipeline_run_against_brute_force(spark):
    """The whole run on the smallest table: which documents reach the packer, and their lengths."""
    pipeline = pytest.importorskip("corpus_pipeline")
    base = "/root/testdata/sf0.001"
    table = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{base}/documents.parquet").collect()]
    scorer = toxicity.Scorer(toxicity.fit(spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")))
    best = {}
    for d, t in table:
        if scorer.score(t) < toxicity.THRESHOLD:
            best[bare(t)] = min(best.get(bare(t), (1, 0)), (-len(t), d))
    texts = dict(table)
    kept = sorted(d for _, d in best.values())
    sets = {d: shingles(texts[d]) for d in kept}
    root = {d: d for d in kept}

    def find(x):
        return x if root[x] == x else find(root[x])

    for i, a in enumerate(kept):
        for b in kept[:i]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    kept = [d for d in kept if find(d) == d]
    tok = CachedTokenizer(default_path("word_bpe_49k.json"))
    clean = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame([(d, texts[d]) for d in kept], "doc_id long, text string")).collect()}
    want = {d: len(tok.tok.encode(clean[d], add_special_tokens=False).ids) + 1 for d in kept}
    got = pipeline.run(spark, base).collect()
    assert {r.doc_id: r.doc_tokens for r in got} == want
    total = defaultdict(int)
    for r in got:
        total[r.doc_id] += r.length
    assert total == want


@pytest.mark.parametrize("same_id", [True, False])
def test_thousands_of_repeated_rows(spark, same_id):
    """Work in proportion to the rows, for one id or none over thousands of rows."""
    rng = random.Random(2)
    body = sentence(rng, 70)
    rows = [(7 if same_id else None, body)] * 5000 + [(7 if same_id else None, sentence(rng, 60)) for _ in range(50)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string")
    began = time.time()
    got = exact_dedup.exact_dedup(df).groupBy("group_size").count().collect()
    assert {(r.group_size, r["count"]) for r in got} == {(5000, 5000), (2, 100)}
    assert exact_dedup.keep_first(df).count() == 51
    if same_id:
        assert ngram_join.ngram_join(df).filter("n_links = 4999").count() == 5000
        assert {(r.start, r.length) for r in suffix_dedup.suffix_dedup(df).collect()} == {(0, 70), (0, 60)}
    assert time.time() - began < 60


def test_redaction_of_many_matches_and_wide_characters(spark):
    n = 20_000
    rows = [(1, "wörd 😀 a.b@c.org, " * n), (2, "\n\n😀 1.2.3.4"), (3, "x +1.2.3.4.55.66.77 a+1@1.2.3.4"), (4, None), (5, "😀")]
    got = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got.pop(1) == "wörd 😀 [EMAIL], " * n
    assert got == {2: "\n\n😀 [IP]", 3: "x [PHONE] [EMAIL]", 4: None, 5: "😀"}


def test_tasks_give_memory_back_and_batches_are_bounded(spark):
    from haplomesh.llm import shingles
    from haplomesh.llm.common import BATCH_ROWS, bound_batches, setting, tidy

    shingles.HASHES["word"] = 1
    assert list(tidy(lambda batches: (b + 1 for b in batches))(iter([1, 2]))) == [2, 3]
    assert not shingles.HASHES
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for before, after in ((10_000, BATCH_ROWS), (0, BATCH_ROWS), (7, 7)):
        with setting(spark, key, before):
            bound_batches(spark)
            assert int(spark.conf.get(key)) == after
