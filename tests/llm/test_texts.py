"""Pages, conversations, archives, licenses and secrets against cases and plain Python."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from moodwire.llm import chat, html_text, license_scan, secret_scan, warc

PAGES = [
    ("<p>a<b>b<br><p>c", "ab\n\nc"),
    ("<ul><li>x<li>y<ol start=3><li>q<li>r</ol><li>z</ul>d", "- x\n- y\n  3. q\n  4. r\n- z\n\nd"),
    (
        "<table><tr><th>Name<th>Qty<tr><td>apple pie<td>3<tr><td colspan=2>both</table>after",
        "Name      | Qty\napple pie | 3\nboth\n\nafter",
    ),
    ("<pre>  a\n\n   b</pre>c", "  a\n\n   b\n\nc".strip("\n")),
    ('<div hidden>no</div>yes<span style="a:b;display : none">no</span>', "yes"),
    ('<i style="visibility:hidden">no</i><input type=hidden value=no><input type=submit value=Go>', "Go"),
    ("a < b &amp; c <!-- no --> d<script>no</script><title>no</title>", "a < b & c d"),
    ("<h1>T</h1>one\n two<div>three</div>four", "T\n\none two\nthree\nfour"),
    ("<dl><dt>a<dd>b<dt>c</dl>", "a\nb\nc"),
    ("</div></p>x<a href=\"q'>y</a>", "xy"),
    ("<select><option>a<option>b</select>", "a\nb"),
    ("<td>loose</td>", "loose"),
    ("<div>" * 30_000 + "deep", "deep"),
    ("<!-- open", ""),
    ("<style>open", ""),
    ("", ""),
    (None, ""),
]


def test_pages(spark):
    rows = [(k, page, "old") for k, (page, _) in enumerate(PAGES)] + [(0, PAGES[0][0], "old"), (None, "n", "old")]
    frame = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = html_text.extract(frame).collect()
    assert len(got) == len(rows)
    for r in got:
        want = "n" if r.page_id is None else PAGES[r.page_id][1]
        assert r.text == want, r.page_id
    assert html_text.extract(frame.limit(0)).count() == 0


def test_no_visible_word_is_lost(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    for page in pages:
        plain = re.sub(r"(?s)<(script|style|title).*?</\1>|<!--.*?-->", "", page.html)
        plain = re.sub(r"<[^>]*>", " ", plain)
        import html

        words = lambda t: "".join(re.findall(r"\w", html.unescape(t)))
        own = "\n".join(re.sub(r"^ *(- |\d+\. )", "", x) for x in html_text.rendered(page.html).split("\n"))
        assert words(own) == words(plain)


HEADS_AND_DRAWINGS = [
    ("<html><head><title>t</title><body><p>a</body></html>", "a"),
    ("<head><meta charset=x><title>t</title>\n<p>a<p>b", "a\n\nb"),
    ("<html><head>\n <style>x</style> words <b>b</b>", "words b"),
    ("<head><noscript><p>no</noscript><template><p>no</template><div>a</div>", "a"),
    ("<head><html lang=x><title>t</title></p></body>a", "a"),
    ("<div>a<head><title>t</title>b</head>c</div>", "abc"),
    ('<div>a<svg width="1" />b<math/>c</div>d', "abc\nd"),
    ('<svg><path d="M0"/><g><circle r="1"/></g></svg>a', "a"),
    ("<svg><path d=M0/>no</svg>a", "a"),
    ("a<svg><title>no</title>no<defs><text>no</text></defs><text>x<tspan>y</tspan></text><text>z</text></svg>b",
     "a xy z b"),
    ("<svg><text><![CDATA[a<b]]></text><text display=none>no</text><style>no</style></svg>c", "a<b c"),
    ("<svg><foreignObject><ul><li>a<li>b</ul></foreignObject></svg>c", "- a\n- b\n\nc"),
    ("<svg><switch><foreignObject><p>a</p></foreignObject><text>no</text></switch></svg>", "a"),
    ("<svg><g><p>a</p>b", "a\n\nb"),
    ("<ul><li>a<svg><foreignObject><li>b</foreignObject></svg><li>c</ul>", "- a\n- b\n- c"),
    ("<math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac><annotation>no</annotation></math>", "x=1 2"),
    ("<div><svg><text>a</div>b", "a\nb"),
]


@pytest.mark.parametrize("page,text", HEADS_AND_DRAWINGS)
def test_heads_and_drawings(page, text):
    assert html_text.rendered(page) == text


TALK = "conv_id long, turn long, role string, text string"


def plain_talk(rows):
    talks = {}
    order = lambda r: [(x is not None, x) for x in r[1:]]
    for conv, turn, role, text in sorted(rows, key=order):
        talks.setdefault(conv, []).append((role or "", text or ""))
    return talks


def test_talks_read_back(spark):
    rng = random.Random(3)
    bits = ["</s>", "<s>", "\\", " ", "\n", "[INST]", "[/INST]", "<<SYS>>", "ok", "é", "<", " </s>\n"]
    rows = []
    for conv in range(40):
        for turn in range(rng.randint(1, 11)):
            text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "a\nb</s>\\", ""]), text))
    rows += [rows[0], (None, 0, "user", "x"), (None, None, None, None), (77, 1, "assistant", None)]
    done = chat.formatted(chat.linear(spark.createDataFrame(rows, TALK)))
    read = done.select("tree", "formatted", chat.parsed(F.col("formatted")).alias("turns"),
                       chat.under_mask(F.col("formatted"), F.col("loss")).alias("learned"))
    got = {r.tree: r for r in read.collect()}
    talks = plain_talk(rows)
    assert len(got) == len(talks)
    for conv, turns in talks.items():
        r = got["null" if conv is None else f"c{conv}"]
        assert [tuple(t) for t in r.turns] == turns
        assert r.learned == "".join(t for role, t in turns if role == "assistant")


def test_branches_are_ranked(spark):
    #      1 ── 2 ── 4        5 is a second root, 6 and 7 a cycle, 8 hangs off a missing parent
    #      └─── 3 ── 9
    nodes = [("t", 1, None, 1.0), ("t", 2, 1, 5.0), ("t", 3, 1, None), ("t", 4, 2, 0.0), ("t", 9, 3, 9.0)]
    nodes += [("t", 5, None, 2.0), ("t", 6, 7, 99.0), ("t", 7, 6, 99.0), ("u", 8, 1, 4.0), ("u", 1000, 999, 4.0)]
    frame = spark.createDataFrame(nodes, "tree string, node long, parent long, score double")
    found = chat.paths(frame, branches=2).collect()
    paths = {}
    for r in sorted(found, key=lambda r: r["at"]):
        paths.setdefault((r.tree, r.rank), []).append(r.node)
    assert paths == {("t", 1): [1, 3, 9], ("t", 2): [1, 2, 4], ("u", 1): [8], ("u", 2): [1000]}
    both = chat.paths(frame, branches=9, by="sum").select("tree", "leaf", "score").distinct().collect()
    assert sorted(map(tuple, both)) == [("t", 4, 6.0), ("t", 5, 2.0), ("t", 9, 10.0), ("u", 8, 4.0), ("u", 1000, 4.0)]


def test_a_long_chain(spark):
    rows = [(1, k, "user" if k % 2 else "assistant", str(k)) for k in range(300)]
    done = chat.formatted(chat.linear(spark.createDataFrame(rows, TALK))).first()
    assert done.n_turns == 300 and len(done.loss) == 150
    assert chat.formatted(chat.linear(spark.createDataFrame([], TALK))).count() == 0


BIG = "z" * 150


def archive(spark, tmp_path, rows):
    path = f"file://{tmp_path}/archives"
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string, digest int"), path)
    return path


@pytest.mark.parametrize("broadcast_rows", [100_000, 0])
def test_archives_round_trip(spark, tmp_path, broadcast_rows):
    rows = [(5, "u", BIG, 1), (3, "http://x/\r\ny", BIG, 1), (9, None, BIG, 1), (1, "a", "small", 1), (2, "a", "small", 1)]
    rows += [(4, "e", "", 1), (6, "n", None, 1), (None, "k", BIG, 1), (7, "é", "é" * 60 + "\r\n\r\nWARC/1.1 x", 1)]
    rows += [(8, "w", "y" * 300_000, 1), (10, "r", "q" * 100, 1), (10, "r", "q" * 100, 1)]
    path = f"file://{tmp_path}/archives"
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    warc.write_archives(pages, path, broadcast_rows=broadcast_rows, per_archive=3)
    got = warc.read_records(spark, path).withColumn("page_id", warc.page_of(F.col("record_id"))).collect()
    assert len(got) == len(rows) and warc.read_gaps(spark, path).count() == 0
    texts = {i: (t or "").encode() for i, _, t, _ in rows}
    for r in got:
        data = texts[r.page_id]
        first = 3 if data == BIG.encode() else None
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        if first and r.page_id != first:
            assert r.record_type == "revisit" and r.refers_to == f"<urn:page:{first}>" and r.payload is None
        else:
            assert r.record_type == "response" and bytes(r.payload) == data and r.refers_to is None
    assert warc.read_records(spark, archive(spark, tmp_path / "none", [])).count() == 0


def test_salvage_steps_over_damage():
    digest = lambda k: hashlib.sha256(f"page {k} WARC/1.1 <s> ".encode() * 9).hexdigest()
    one = [
        warc.record(k, f"u{k}", f"page {k} WARC/1.1 <s> ".encode() * 9, digest(k), None, "2000") for k in range(6)
    ]
    for units in ([warc.member(r) for r in one], one):
        whole = b"".join(units)
        ends = [sum(map(len, units[: k + 1])) for k in range(6)]
        ids = lambda content: [int(r[2][10:-1]) for r in warc.salvage(content)[0]]
        assert ids(whole) == [0, 1, 2, 3, 4, 5] and warc.salvage(whole)[1] == []
        hurt = bytearray(whole)
        hurt[ends[1] + len(units[2]) // 2] ^= 255
        assert ids(bytes(hurt)) == [0, 1, 3, 4, 5]
        assert [g[:2] for g in warc.salvage(bytes(hurt))[1]] == [(ends[1], ends[2])]
        cut = whole[: ends[4] + 20]
        assert ids(cut) == [0, 1, 2, 3, 4] and [g[:2] for g in warc.salvage(cut)[1]] == [(ends[4], len(cut))]
        mixed = b"junk" + units[0] + b"\0" * 50 + units[1]
        assert ids(mixed) == [0, 1]
        assert [g[:2] for g in warc.salvage(mixed)[1]] == [(0, 4), (4 + len(units[0]), 54 + len(units[0]))]
    assert warc.salvage(b"nothing here")[1] == [(0, 12, "no version line")]
    assert warc.salvage(b"") == ([], [])


def test_salvage_inside_members(spark, tmp_path):
    rng = random.Random(5)
    data = [bytes(rng.choices(b"abcdefgh <>", k=3000)) for _ in range(8)]
    one = [warc.record(k, "u", d, hashlib.sha256(d).hexdigest(), None, "2000") for k, d in enumerate(data)]
    ids = lambda content: [int(r[2][10:-1]) for r in warc.salvage(content)[0]]
    starts = [sum(map(len, one[:k])) for k in range(9)]
    for level in (0, 6):
        # A record whose digest fails, between good ones of a whole member.
        bad = one[:2] + [one[2].replace(data[2], data[2][::-1])] + one[3:5]
        head, tail = warc.member(b"".join(bad), level), warc.member(b"".join(one[5:]), level)
        found, gaps = warc.salvage(head + tail)
        assert ids(head + tail) == [0, 1, 3, 4, 5, 6, 7] and [r[0] for r in found] == [0] * 4 + [len(head)] * 3
        assert gaps == [(0, len(head), "digest does not match", starts[2], starts[3])]
        # Cut at every length: the records before the cut, none twice, and one gap.
        whole = warc.member(b"".join(one), level)
        seen = set()
        for end in range(0, len(whole), 97):
            got, gaps = ids(whole[:end]), warc.salvage(whole[:end])[1]
            assert got == list(range(len(got))) and len(gaps) == (end > 0)
            if got:
                assert gaps[0][:4] == (0, end, "member is cut off", starts[len(got)])
            seen.add(len(got))
        assert seen >= set(range(8))
        # Damage: all before it, and the next member; the rest of a stream cannot be read once it is lost.
        first = warc.member(b"".join(one[:5]), level)
        for at in range(12, len(first), 61):
            hurt = bytearray(first + tail)
            hurt[at] ^= 255
            got = ids(bytes(hurt))
            assert got[-3:] == [5, 6, 7] and len(set(got)) == len(got)
            at_least = at * 5 // len(first) - 1
            assert got[: max(0, at_least)] == list(range(at_least))
            assert warc.salvage(bytes(hurt))[1]
    cut = warc.member(b"".join(one))[:-9]
    (tmp_path / "x.warc.gz").write_bytes(cut)
    gap = warc.read_gaps(spark, f"file://{tmp_path}").first()
    assert warc.read_records(spark, f"file://{tmp_path}").count() >= 7
    assert (gap.start, gap.end, gap.reason) == (0, len(cut), "member is cut off") and gap.inner_start >= starts[7]
    # Without a digest a record of a damaged member is not known to be good; a lone record needs its sum.
    bare = [re.sub(rb"WARC-(Block|Payload)-Digest: [^\r]*\r\n", b"", r) for r in one]
    for records, want in ((bare, []), (one, list(range(8))), (one[:1], [])):
        off = bytearray(warc.member(b"".join(records)))
        off[-6] ^= 1
        assert ids(bytes(off)) == want
    assert ids(warc.member(b"".join(bare))) == list(range(8))


def test_licenses(spark):
    notices = license_scan.templates(spark)
    by_name = {}
    for name, text in license_scan.TEMPLATES:
        by_name.setdefault(name, []).append(text)
    filler = " ".join(f"word{k}" for k in range(300))
    rows, want = [], {}
    for k, (name, text) in enumerate(license_scan.TEMPLATES):
        rows.append((k, f"{filler}\n{text.upper()} {filler}"))
        want[k] = name
    rows += [(100, None), (101, ""), (102, "license"), (103, filler + " license"), (104, "released under the mit"),
             (105, "x license " * 2_000), (0, rows[0][1]), (None, "Released under the MIT License")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, licenses int")
    got = license_scan.scan(frame, notices)
    found = got.collect()
    assert len(found) == len(rows)
    for r in found:
        names = [x.license for x in r.licenses]
        if r.doc_id in want:
            assert want[r.doc_id] in names
            assert all(x.share >= 0.8 for x in r.licenses)
        else:
            assert names == (["MIT"] if r.doc_id is None else [])
    assert license_scan.scan(frame.limit(0), notices).count() == 0
    assert license_scan.scan(frame, notices.limit(0)).where(F.size("licenses") > 0).count() == 0
    same = license_scan.scan(frame, notices, broadcast_rows=0).collect()
    assert sorted(map(str, same)) == sorted(map(str, found))


KINDS = [
    ("assign", re.compile(secret_scan.NAMED, re.I | re.A), 2, 8),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile("[0-9a-f]+"), 0, 32),
]


def test_owners_and_repositories_of_secrets(spark):
    mirrored, many, spread = "Zx9Kq2Lm8Wn4Rt7Yp1Vb6Uc3", "Ab1Cd2Ef3Gh4Ij5Kl6Mn7Op8", "Qw1Er2Ty3Ui4Op5As6Df7Gh8"
    rows = [(k, f"key {mirrored}", f"s{k % 2}", lang) for k, lang in enumerate(["en", "de", "fr", "es"])]
    rows += [(k, f"key {many}", "hot", f"l{k}") for k in range(10, 15)]
    rows += [(k, f"key {spread} secret=copied-by-all", f"s{k}", "en") for k in (20, 21, 22)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    scanned = secret_scan.scan(frame, repositories=4)
    clean = secret_scan.redacted(F.col("text"), F.col("secrets"), example="[EXAMPLE]")
    got = {r.doc_id: r for r in scanned.withColumn("clean", clean).collect()}
    for k in range(4):  # two owners, four repositories: still live
        assert [tuple(s)[3:] for s in got[k].secrets] == [("token", 4, True, 2, 4)]
        assert got[k].clean == "key [SECRET]"
    assert all(got[k].secrets == [] for k in range(10, 15))  # one owner, five repositories
    for k in (20, 21, 22):
        assert [(s.kind, s.live, s.owners, s.repositories) for s in got[k].secrets] == [("assign", False, 3, 3)]
        assert got[k].clean == f"key {spread} secret=[EXAMPLE]"
    assert {r.doc_id for r in secret_scan.scan(frame).collect() if r.secrets} == {0, 1, 2, 3, *range(10, 15), 20, 21, 22}


def plain_spans(text):
    found = []
    for rank, (kind, pattern, group, least) in enumerate(KINDS):
        for m in pattern.finditer(text or ""):
            if len(m[group]) >= least:
                found.append((m.start(), rank, m.end(), kind, m.start(group)))
    return sorted(found)


def test_secrets(spark):
    rng = random.Random(12)
    bits = ["password", "Token", "api_key", "=", ": ", '"', "'", "AKIA", "ABCDEFGH1234", "0123456789abcdef" * 2, " ",
            "é", "🙂", "hunter2hunter2", "\n", "secret", "a", "AKIAAKIA00000000", "x/y+z.w-v_u"]
    rows = [(k, "".join(rng.choice(bits) for _ in range(rng.randint(0, 25))), "s1", "en") for k in range(150)]
    own, shared = "Zx9Kq2Lm8Wn4Rt7Yp1Vb6Uc3", "Ab1Cd2Ef3Gh4Ij5Kl6Mn7Op8"
    rows += [(200, f"key {own} end", "s1", "en"), (201, f"again {own}", "s1", "de")]
    rows += [(k, f"copied {shared}", f"s{k}", "en") for k in range(210, 213)]
    rows += [(300, None, None, None), (301, "", None, "en"), (None, "token=abcdefgh", None, None), rows[3], rows[3]]
    rows += [(302, "token=abcdefgh " * 2000, "s9", "en")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, lang string, secrets int")
    scanned = secret_scan.scan(frame)
    got = scanned.withColumn("clean", secret_scan.redacted(F.col("text"), F.col("secrets"))).collect()
    assert len(got) == len(rows)
    for r in got:
        base = [tuple(s)[:5] for s in r.secrets if s.rank < secret_scan.BASE]
        assert base == plain_spans(r.text)
        values = [(s.value_start, s.end) for s in r.secrets]
        want, at = "", 0
        for a, b in sorted(values):
            if a >= at:
                want += (r.text or "")[at:a] + "[SECRET]"
            at = max(at, b)
        assert (r.clean or "") == want + (r.text or "")[at:]
    by = {r.doc_id: [(s.kind, s.live) for s in r.secrets] for r in got}
    assert by[200] == by[201] == [("token", True)]
    assert by[210] == by[211] == []
    assert secret_scan.scan(frame.limit(0)).count() == 0
