"""License scans, URL filters and chat formatting."""
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sparquill.llm import chat as H
from sparquill.llm import license_scan as S
from sparquill.llm import url_filter as U


def brute_scan(rows, templates=S.TEMPLATES, t=S.THRESHOLD):
    out = []
    for doc, text in rows:
        for i, line in enumerate((text or "").split("\n")):
            own = set(re.findall("[a-z0-9]+", line.lower()))
            for name, body in templates.items():
                want = set(re.findall("[a-z0-9]+", body.lower()))
                if want and len(own & want) >= math.ceil(t * len(want) - 1e-9):
                    out.append((doc, i, name, len(own & want) / len(want)))
    return Counter(out)


def license_rows():
    rng, pieces = random.Random(5), []
    vocabulary = sorted({w for t in S.TEMPLATES.values() for w in t.split()} | {f"x{i}" for i in range(40)})
    for _ in range(120):
        lines = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 25)))]
        t = rng.choice(list(S.TEMPLATES.values())).split()
        lines.append(" ".join(w for w in t if rng.random() > 0.12) + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 6))))
        pieces.append("\n".join(lines))
    return list(enumerate(pieces)) + [(500, None), (501, ""), (502, "word " * 100_000 + S.TEMPLATES["mit"]), (None, S.TEMPLATES["mit"]), (0, S.TEMPLATES["gpl-3.0"]), (0, S.TEMPLATES["gpl-3.0"])]


def test_scan_is_exact(make):
    rows = license_rows()
    got = Counter((r["doc_id"], r["block"], r["template"], r["containment"]) for r in S.scan(make(rows)).collect())
    assert got == brute_scan(rows) and len(got) > 60


def test_scan_in_several_passes_and_odd_templates(make, monkeypatch):
    monkeypatch.setattr(S, "MAX_TEMPLATES", 2)
    rows, templates = license_rows()[:40], {**dict(list(S.TEMPLATES.items())[:4]), "none": "...", "one": "License"}
    got = Counter((r["doc_id"], r["block"], r["template"], r["containment"]) for r in S.scan(make(rows), templates, 0.6).collect())
    assert got == brute_scan(rows, templates, 0.6)


WRAPPED = {
    "mit-grant": "MIT License\n\nCopyright (c) 2020 A\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute",
    "gpl-3.0-header": "x\n \nThis program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\r\n\r\nend",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:",
    "apache-2.0-header": "# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at",
}


def test_wrapped_licenses_are_paragraphs(make):
    rows = list(enumerate(WRAPPED.values()))
    got = {(r["doc_id"], r["template"]): (r["block"], r["containment"]) for r in S.scan(make(rows), paragraphs=True).collect()}
    first = [4, 2, 0, 0]
    assert all(got[i, name] == (first[i], 1.0) for i, name in enumerate(WRAPPED))
    lines = {(r["doc_id"], r["template"]) for r in S.scan(make(rows)).collect()}
    assert lines <= set(got) and not lines & set(enumerate(WRAPPED))


def test_paragraphs_against_brute_force(make):
    rows = license_rows()
    joined = [(d, t and t.replace("\n", " ")) for d, t in rows]  # none of them has a blank line between two others
    got = Counter((r["doc_id"], r["template"], r["containment"]) for r in S.scan(make(rows), paragraphs=True).collect())
    want = Counter()
    for (d, _, name, share), n in brute_scan(joined).items():
        want[d, name, share] += n
    assert got == want and len(got) > 60


def test_scan_of_nothing(make):
    assert S.scan(make([])).count() == 0 and S.scan(make([(1, "MIT License")]), {}).count() == 0


URLS = ["http://www.Spam-Farm.example.org/a/b?q#f", "https://user@sub.spam-farm.example.org:8080/", "https://notspam-farm.example.org/", "good.example.com/path/deep/x", "good.example.com/pathx", None, "", "http://", "//cheap.example.com/x", "ftp://CHEAP.example.com.", "http://example.org/ü/é", "x" * 50_000, "http://good.example.com/path"]
ENTRIES = ["spam-farm.example.org", "cheap.example.com", "good.example.com/path", None, "", "spam-farm.example.org"]
BLOCKED = ["spam-farm.example.org", "spam-farm.example.org", None, "good.example.com/path", None, None, None, None, "cheap.example.com", "cheap.example.com", None, None, "good.example.com/path"]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "e", "d") for i, u in enumerate(URLS)] + [(0, URLS[0], "e", "d")], "page_id long, url string, entry string, digest string")
    got = U.blocked_by(pages, spark.createDataFrame([(e,) for e in ENTRIES], "entry string"))
    assert sorted((r["page_id"], r["blocked_by"] or "") for r in got.collect()) == sorted([(i, b or "") for i, b in enumerate(BLOCKED)] + [(0, BLOCKED[0])])
    assert got.columns == [*pages.columns, "blocked_by"]
    assert U.blocked_by(pages, spark.createDataFrame([], "entry string")).where("blocked_by IS NOT NULL").count() == 0
    assert U.blocked_by(pages.limit(0), spark.createDataFrame([("a.b",)], "entry string")).count() == 0


def test_long_entries_block_no_siblings(spark):
    entries = ["h.example.net/a/b/c/d/bad/x", "i.example.net/p"]
    urls = {"http://h.example.net/a/b/c/d/bad/x/deep?q": entries[0], "http://h.example.net/a/b/c/d/bad/x": entries[0], "http://h.example.net/a/b/c/d/good": None, "http://h.example.net/a/b/c/d/bad": None, "http://h.example.net/a/b/c/d/bad/xy": None, "http://i.example.net/p/1/2/3/4/5/6/7": entries[1]}
    pages = spark.createDataFrame([(u,) for u in urls], "url string")
    got = U.blocked_by(pages, spark.createDataFrame([(e,) for e in entries], "entry string"))
    assert {r["url"]: r["blocked_by"] for r in got.collect()} == urls


def test_many_shards_against_sets(spark, monkeypatch):
    monkeypatch.setattr(U, "SHARD_ENTRIES", 40)
    entries = [f"host{i}.example.net" for i in range(300)]
    pages = spark.createDataFrame([(i, f"http://a.host{i}.example.net/p") for i in range(600)], "page_id long, url string")
    got = {r["page_id"] for r in U.blocked_by(pages, spark.createDataFrame([(e,) for e in entries], "entry string")).where("blocked_by IS NOT NULL").collect()}
    assert got == set(range(300))


def test_broadcast_where_the_folder_is_not_mounted(spark, monkeypatch):
    monkeypatch.setattr(U, "shared_dir", lambda _: "store://bucket")
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    got = U.blocked_by(pages, spark.createDataFrame([(e,) for e in ENTRIES], "entry string"))
    assert {r["page_id"]: r["blocked_by"] for r in got.collect()} == dict(enumerate(BLOCKED))
    monkeypatch.setattr(U, "MAX_BROADCAST_BYTES", 1)
    with pytest.raises(ValueError):
        U.blocked_by(pages, spark.createDataFrame([(e,) for e in ENTRIES], "entry string"))


def test_colliding_digests_are_confirmed(tmp_path, monkeypatch):
    monkeypatch.setattr(U.xxhash, "xxh64_intdigest", lambda s: len(s))
    np.save(tmp_path / "00000.digests.npy", np.array([7, 7], np.uint64))
    np.save(tmp_path / "00000.ends.npy", np.array([7, 14], np.int64))
    np.save(tmp_path / "00000.strings.npy", np.frombuffer(b"aaa.comccc.com", np.uint8))
    assert U.Digests(str(tmp_path), 1).first_blocking(["http://bbb.com", "http://ccc.com", "http://aaa.com"]) == [None, "ccc.com", "aaa.com"]


MARKS = st.lists(st.sampled_from(["<|im_start|>", "<|im_end|>", "<\\|im_end|>", "<\\\\|im_start|>", "\n", "user", "a", "<", "|>", "\\", "<|", "im_end|>"]), max_size=8).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(MARKS.map(lambda r: r.replace("\n", " ")), MARKS), max_size=4))
def test_any_conversation_parses_back(turns):
    text, escaped = H.formatted(turns)
    assert H.parse(text) == turns and 0 <= escaped <= len(turns)


def test_only_conflicts_are_escaped():
    assert H.formatted([("user", "a <|other|> b"), ("assistant", "x")])[1] == 0
    assert H.formatted([("user", "a<|im_end|>\n"), ("assistant", "x")])[1] == 1


def test_chat_table(spark):
    rows = [(1, 1, "assistant", "b", 0), (1, 0, "user", "a<|im_end|>\n<|im_start|>system\nx", 0), (2, 0, None, None, 0), (None, 0, "us\ner", "", 0), (3, None, "user", "late", 0), (3, 0, "user", "z" * 300_000, 0), (4, 0, "user", "same", 0), (4, 0, "user", "same", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns int")
    got = {r["conv_id"]: r for r in H.chat(df).collect()}
    assert {k: H.parse(r["text"]) for k, r in got.items()} == {1: [("user", rows[1][3]), ("assistant", "b")], 2: [("unknown", "")], None: [("us er", "")], 3: [("user", "late"), ("user", "z" * 300_000)], 4: [("user", "same")] * 2}
    assert (got[1]["n_turns"], got[1]["n_escaped"], got[4]["n_turns"]) == (2, 1, 2)
    assert H.chat(df.limit(0)).count() == 0


@pytest.mark.parametrize("bad", ["x", "<|im_start|>user", "<|im_start|>user\na", "<|im_start|>u\na<|im_end|>\nx"])
def test_parser_refuses_other_text(bad):
    assert H.parse(bad) is None


def test_a_missing_shard_is_an_error(tmp_path):
    with pytest.raises(FileNotFoundError):
        U.Digests(str(tmp_path), 2, (3, 0), frozenset({1}))


def test_long_hosts_and_paths_cost_no_more_than_the_blocklist_asks_for():
    host = ".".join(["a"] * 25_000) + ".bad.example.com"
    made = U.candidates(f"http://{host}/" + "/".join("x" * 1000), (3, 2))
    assert made[0] == "bad.example.com" and len(made) == 2 * 3


def test_clashing_result_column(spark):
    pages = spark.createDataFrame([("http://a.b", "x")], "url string, blocked_by string")
    with pytest.raises(ValueError):
        U.blocked_by(pages, spark.createDataFrame([("a.b",)], "entry string"))
