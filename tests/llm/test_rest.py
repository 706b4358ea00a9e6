"""Operators 3, 5, 6, 8, 9 and 10: brute force, round trips, awkward rows; SQL equality is in test_oracles."""

import base64
import gzip
import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanforge.llm import components, op3_line_rules, op5_warc, op6_reply_trees, op8_telephony, op9_simhash, op10_trie_bpe

AWKWARD = [(1, None), (2, ""), (3, " \n\t"), (4, "One two\nOne two\n# $ é"), (5, "b c d e f " * 4), (5, "b c d e f " * 4), (None, "x y z"), (None, None), (6, "word " * 30000)]


def test_rules_on_awkward_rows(docs_of):
    rows = {(r["doc_id"], r["n_words"]): r for r in op3_line_rules.verdicts(docs_of(AWKWARD)).collect()}
    assert len(op3_line_rules.verdicts(docs_of(AWKWARD)).collect()) == len(AWKWARD)
    assert (rows[4, 7]["word_chars"], rows[4, 7]["n_symbols"], rows[4, 7]["n_dup_lines"]) == (15, 2, 1)
    assert rows[5, 20]["n_repeat_words"] == 20 and rows[5, 20]["base_failed"] and not rows[5, 20]["kept"]
    assert rows[6, 30000]["n_repeat_words"] == 30000
    assert op3_line_rules.verdicts(docs_of([])).collect() == []


def test_boilerplate_goes_and_depleted_documents_fail(docs_of):
    rng = random.Random(1)
    own = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    line = "Share this page with all of your friends today please and thank you"
    rows = [(i, f"{own(40)}\n{line}") for i in range(60)] + [(100, f"{line}\n{own(4)}"), (101, own(40), "en", "other"), (102, f"{own(40)}\n{line}", "en", "other")]
    found = {r["doc_id"]: r for r in op3_line_rules.verdicts(docs_of(rows)).collect()}
    assert found[0]["removed_words"] == 0 and found[1]["removed_words"] == 13 and found[1]["kept"]
    assert not found[100]["kept"] and not found[100]["base_failed"]
    assert found[102]["removed_words"] == 0 and found[101]["kept"]


def test_warc_round_trip(spark):
    rows = [(i, f"http://www.b.example/{i % 3}?z=1&a=2", "<p>" + "x" * i) for i in range(40)]
    rows += [(50, None, None), (51, "http://a b\r\n", ""), (52, "x", "é\r\n\r\nWARC/1.1\r\n"), (53, "y", "é\r\n\r\nWARC/1.1\r\n"), (None, "y", "z"), (53, "y", "é\r\n\r\nWARC/1.1\r\n")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, record_type string")
    found = op5_warc.archived(pages).collect()
    assert len(found) == len(rows)
    by = {r["page_id"]: r for r in found}
    for i, _, html in rows:
        raw = (html or "").encode()
        assert (by[i]["payload_bytes"], by[i]["payload_digest"]) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
    assert [(by[i]["record_type"], by[i]["refers_to"]) for i in (50, 51, 52, 53)] == [("response", None), ("revisit", 50), ("response", None), ("revisit", 52)]
    ordered = sorted(found, key=lambda r: (r["shard"], r["position"]))
    keys = [(r["url_key"], r["captured"]) for r in ordered]
    assert keys == sorted(keys)
    assert op5_warc.archived(pages.limit(0)).collect() == []


def test_warc_members_large_records_and_offsets(spark, tmp_path):
    from pathlib import Path

    rng = random.Random(5)
    big = "".join(rng.choice("abcdefgh <>") for _ in range(1 << 16)) * 320  # 20 MiB: two members
    rows = [(i, f"http://h{i % 7}.org/{i}", f"<p>{i % 11}</p>") for i in range(500)] + [(900, "http://h.org/big", big), (901, "http://h.org/again", big), (902, None, "x" * (1 << 22))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = str(tmp_path / "warc")
    op5_warc.write_archives(pages, folder)
    found = op5_warc.capture_runs(spark, folder).collect()
    assert len(found) == len(rows) and {r["refers_to"] for r in found if r["id"] == 901} == {900}
    for r in found:
        if r["id"] % 50 == 0 or r["id"] >= 900:  # each record by itself, from its place in the compressed file
            raw = (Path(folder) / r["run"]).read_bytes()[r["record_offset"] : r["record_offset"] + r["record_length"]]
            text = gzip.decompress(raw)
            assert text.startswith(b"WARC/1.1\r\n") and f"<urn:page:{r['id']}>".encode() in text[:300] and text.endswith(b"\r\n\r\n")
            if r["record_type"] == "response":
                assert text[:-4].endswith(dict((a, c) for a, _, c in rows)[r["id"]].encode())


def test_warc_minimum_size(spark):
    pages = spark.createDataFrame([(1, "u", "same"), (2, "v", "same")], "page_id long, url string, html string")
    assert {r["record_type"] for r in op5_warc.archived(pages, min_revisit_bytes=5).collect()} == {"response"}


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7])
def test_loser_tree_merges(k):
    rng = random.Random(k)
    runs = [sorted((rng.randrange(50),) for _ in range(rng.randrange(20))) for _ in range(k)]
    merged = [runs[r][p] for r, p in op5_warc.LoserTree(runs)] if k else []
    assert merged == sorted(x for r in runs for x in r)


def test_reply_trees_choose_the_best_branch(spark):
    messages = [(1, 1, None, 0.0, "user", "q"), (1, 2, 1, 1.0, "assistant", "low"), (1, 3, 1, 5.0, "assistant", "h|<i>\\"), (1, 4, 3, 1.0, None, None), (1, 5, 3, 0.5, "user", "no"), (2, 8, 9, 0.0, "user", "loop"), (2, 9, 8, 0.0, "user", "loop"), (3, 1, 77, 0.0, "user", "orphan")]
    table = spark.createDataFrame(messages, "tree long, id long, parent long, score double, role string, text string")
    found = {r["tree"]: r for r in op6_reply_trees.read_back(op6_reply_trees.formatted(table)).collect()}
    assert set(found) == {1, 3}
    assert [(t["role"], t["text"]) for t in found[1]["turns"]] == [("user", "q"), ("assistant", "h|<i>\\"), ("", "")]
    assert found[1]["loss_text"] == "h|<i>\\"
    two = op6_reply_trees.chosen_paths(table, top=2).where("tree = 1").groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {(r["leaf"], r["n"]) for r in two} == {(4, 3), (5, 3)}


def test_long_threads_and_awkward_turns(spark):
    rows = [(7, i, "assistant" if i % 2 else "user", f"</s>{i}\\<|x|>") for i in range(150)] + [(8, 1, None, None), (8, 1, None, None), (None, 3, "user", "a"), (9, None, "user", "b")]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, tree string")
    found = {r["conv_id"]: r for r in op6_reply_trees.digests(op6_reply_trees.formatted(op6_reply_trees.thread_messages(table))).collect()}
    whole = "".join(f"{r}\n{t}\n" for _, _, r, t in rows[:150])
    loss = "".join(t for _, _, r, t in rows[:150] if r == "assistant")
    assert (found[7]["n_turns"], found[7]["turns_sha256"], found[7]["loss_chars"], found[7]["loss_sha256"]) == (150, hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert found[8]["n_turns"] == 2 and found[None]["n_turns"] == 1 and found[9]["n_turns"] == 1
    assert op6_reply_trees.digests(op6_reply_trees.formatted(op6_reply_trees.thread_messages(table.limit(0)))).collect() == []


def test_telephony_round_trip(docs_of):
    found = op8_telephony.stored_features(docs_of(AWKWARD), keep_pcm=True).collect()
    assert len(found) == len(AWKWARD)
    texts = {len((t or "").encode()): (t or "").encode() for _, t in AWKWARD}
    for r in found:
        raw = texts[r["n_bytes"]]
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r["payload_bytes"], r["payload_sha256"]) == (len(payload), hashlib.sha256(payload).hexdigest())
        codec = op8_telephony.CODECS[zlib.crc32(payload) % 3]
        head = {"ulaw": (7, 8000, 1, 8), "alaw": (6, 8000, 1, 8), "adpcm": (17, 8000 * 576 // 1145, 576, 4)}[codec]
        form = struct.pack("<HHIIHH", head[0], 1, 8000, *head[1:]) + (struct.pack("<HH", 2, 1145) if codec == "adpcm" else struct.pack("<H", 0))
        media = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(payload)) + payload
        media = b"RIFF" + struct.pack("<I", len(media)) + media
        assert (r["media_bytes"], r["media_sha256"], r["tail_crc32"]) == (len(media), hashlib.sha256(media).hexdigest(), zlib.crc32(payload[-32:]))
        pcm = np.frombuffer(r["pcm"], "<i2").astype(np.int64)
        samples = len(payload) if codec != "adpcm" else len(payload) // 576 * 1145
        crossed = int(((pcm[1:] < 0) != (pcm[:-1] < 0)).sum())
        assert len(pcm) == 2 * samples
        assert r["feature"] == f"{codec};rate=16000;samples={2 * samples};peak={abs(pcm).max()};power={(pcm * pcm).sum()};crossings={crossed};pcm_crc32={zlib.crc32(r['pcm'])}"
    assert op8_telephony.stored_features(docs_of([])).collect() == []


def test_resampling_is_a_low_pass_filter():
    weights = op8_telephony.half_band()
    assert weights.sum() == 32768 and (weights == weights[::-1]).all()
    t = np.arange(4000)
    tone = np.round(10000 * np.sin(2 * np.pi * 0.05 * t)).astype(np.int16)
    want = 10000 * np.sin(2 * np.pi * 0.025 * np.arange(8000))
    got = op8_telephony.resampled(tone)
    assert (got[::2] == tone).all() and abs(got.astype(float) - want)[40:-40].max() < 60
    naive = np.array([sum(int(w) * int(tone[min(max(i + k - 7, 0), 3999)]) for k, w in enumerate(weights)) + 16384 >> 15 for i in range(0, 4000, 97)])
    assert (got[1::2][::97] == naive).all()


def test_telephony_codecs():
    assert op8_telephony.TABLES["ulaw"][[0, 127, 128, 255]].tolist() == [-32124, 0, 32124, 0]
    assert op8_telephony.TABLES["alaw"][[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]
    rng = np.random.default_rng(0)
    blocks = rng.integers(0, 256, (3, 576)).astype(np.uint8)
    got = op8_telephony.adpcm(blocks)
    for block, row in zip(blocks, got):  # one sample at a time
        value, index = struct.unpack("<h", block[:2].tobytes())[0], min(int(block[2]), 88)
        want = [value]
        for byte in block[4:].tolist():
            for nibble in (byte & 15, byte >> 4):
                step = int(op8_telephony.STEPS[index])
                change = (step >> 3) + sum(step >> s for bit, s in ((4, 0), (2, 1), (1, 2)) if nibble & bit)
                value = max(-32768, min(32767, value - change if nibble & 8 else value + change))
                index = max(0, min(88, index + int(op8_telephony.INDEX_STEP[nibble & 7])))
                want.append(value)
        assert row.tolist() == want


def naive_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = low.encode().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_against_all_pairs(documents, docs_of):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()] + [(i, t) for i, t in AWKWARD if i is not None and i != 6]
    rows = list({(i + 1000 if n >= 200 else i): (i + 1000 if n >= 200 else i, t) for n, (i, t) in enumerate(rows)}.values())
    prints = {i: naive_fingerprint(t) for i, t in rows}
    parent = {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 4 and root(a) != root(b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    for limit in (20000, 2):  # buckets compared in the task, and large ones through common points
        found = op9_simhash.simhash_groups(docs_of(rows), bucket_limit=limit).collect()
        assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in found} == {i: (f"{prints[i]:016x}", root(i)) for i in ids}


def test_simhash_awkward_rows(docs_of):
    found = op9_simhash.simhash_groups(docs_of(AWKWARD)).collect()
    assert len(found) == len(AWKWARD)
    assert {r["component_id"] for r in found if r["fingerprint"] == "0" * 16} == {1}
    assert op9_simhash.simhash_groups(docs_of([])).collect() == []


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 130)] + [(200, 201), (201, 202), (202, 200)]
    found = {r["node"]: r["root"] for r in components.roots(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 200: 200, 201: 200, 202: 200}


def test_bpe_equals_the_library(documents, docs_of):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    rng = random.Random(1)
    parts = ["\x1c", "\x85", "\xa0", " ", "  ", "\n", "\t", "a", "'s", "'S", "é", "ß", "漢", "１", "½", "́", "😀", "<|endoftext|>", "###", "ing", "the", "\x00", "Ⅷ", "123", "　"]
    fuzz = [(5000 + i, "".join(rng.choice(parts) for _ in range(rng.randrange(25)))) for i in range(400)]
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()] + fuzz + [(9000, None), (9001, "z" * 20000), (None, "n"), (9002, "r"), (9002, "r")]
    encoded = op10_trie_bpe.encode_texts(docs_of(rows), path)
    found = op10_trie_bpe.digests(encoded).collect()
    assert len(found) == len(rows)
    by = {r["doc_id"]: r for r in found}
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        text = tok.decode(ids, skip_special_tokens=False)
        assert (by[i]["n_tokens"], by[i]["ids_sha256"], by[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()), i
    assert op10_trie_bpe.digests(op10_trie_bpe.encode_texts(docs_of([]), path)).collect() == []
