import hashlib
import random
import re

from corpuslab.llm.secrets import ORACLE, RULES, Scanner, either, find_secrets, op10_secret_scan, redact

BASE = {
    "assign": re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace("(?i:", "(?ai:")),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}


def brute(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in pattern.finditer(text):
            if kind == "assign" and len(m[2]) < 6 or kind == "access" and len(m[0]) < 20 or kind == "hex" and len(m[0]) < 24:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_against_regular_expressions():
    rng = random.Random(3)
    parts = ["password", "PASSWD", "token", "secret", "api_key", "APIkey", '"', "'", " ", "  ", ":", "=", "AKIA", "ABCDEFGHIJKLMNOP0", "abcdef0123456789", "deadbeef", "é", "\n", ",", "zz", "-", "ghp_", "x"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 40))) for _ in range(3000)]
    texts += ["", "é" * 5000 + "token=abcdef" + "q" * 9000 + " AKIA" + "A" * 30, "token=token:abcdefgh", "AKIA" * 9]
    found = Scanner().scan([t.encode() for t in texts])
    for t, got in zip(texts, found, strict=True):
        assert [x for x in got if x[1] < 3] == brute(t), t


def test_added_kinds():
    kinds = [r[0] for r in RULES]
    text = "a ghp_" + "a1B2" * 9 + ", -----BEGIN RSA PRIVATE KEY-----\nxoxb-123456789012-abcdefghij"
    assert [kinds[k] for _, k, _ in Scanner().scan([text.encode()])[0]] == ["github", "pem", "slack"]


def test_key_blocks(spark):
    """The whole block goes: header fields, body, END line; without that line the base64 lines; prose stays."""
    body = "\n".join(["MIIEpAIBAAKCAQEA" + "aB3+/" * 9] * 12 + ["Qx=="])
    head, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    whole = f"{head}\n{body}\n{end}"
    fields = f"{head}\r\nProc-Type: 4,ENCRYPTED\r\nDEK-Info: AES-128-CBC,00FF\r\n\r\n{body}\r\n{end}"
    escaped = whole.replace("\n", "\\n")
    cut = f"{head}\n{body}"
    texts = [f"é {whole} after", f"{fields}\nafter", f"k={escaped};", f"{cut}\nSome words follow here", f"{head} and no more", f"{whole}\n{whole}", f"a {head}", body]
    want = [[(2, 2 + len(whole))], [(0, len(fields))], [(2, 2 + len(escaped))], [(0, len(cut) - 5)], [(0, len(head))], [(0, len(whole)), (len(whole) + 1, 2 * len(whole) + 1)], [(2, 2 + len(head))], []]
    pem = [r[0] for r in RULES].index("pem")
    joined = re.compile(RULES[pem][1] + either("pem"))
    for t, found, spans in zip(texts, Scanner().scan([t.encode() for t in texts]), want, strict=True):
        assert [(s, e) for s, k, e in found if k == pem] == spans == [m.span() for m in joined.finditer(t)], t
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["text"] for r in redact(df).orderBy("doc_id").collect()]
    assert got[:2] == ["é [SECRET] after", "[SECRET]\nafter"] and got[3].endswith("Some words follow here") and got[5] == "[SECRET]\n[SECRET]"


def test_key_blocks_against_sql(spark, tmp_path):
    import duckdb

    head, end = "-----BEGIN PRIVATE KEY-----", "-----END PRIVATE KEY-----"
    rng = random.Random(5)
    parts = [head, end, "\n", "\nA: b", "x" * 44, "\n" + "y" * 41, " ", "-", "word", "\r\n", "token=abcdef12", "é"]
    rows = [(k, "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))) for k in range(800)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = dict(con.sql(f"SELECT doc_id, spans FROM ({ORACLE})").fetchall())
    got = {r["doc_id"]: r["spans"] for r in op10_secret_scan(spark, str(tmp_path)).collect()}
    assert got == want and sum("pem" in x for x in got.values()) > 100


def test_edges(spark, edge_docs):
    rows = {r["doc_id"]: r for r in find_secrets(edge_docs).collect() if r["doc_id"] is not None}
    assert rows[1]["secrets"] == [] and rows[2]["secrets"] == []
    assert find_secrets(edge_docs.limit(0)).count() == 0
    assert find_secrets(edge_docs).count() == edge_docs.count()
    df = spark.createDataFrame([(1, "my token=abcdef99 ok", "x"), (2, None, "y")], "doc_id long, text string, secrets string")
    assert [r["text"] for r in redact(df).orderBy("doc_id").collect()] == ["my [SECRET] ok", None]
    assert [len(r["secrets"]) for r in find_secrets(df).orderBy("doc_id").collect()] == [1, 0]


def test_query(spark):
    sf_dir = "/root/testdata/sf0.01"  # the smaller table holds no secrets
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op10_secret_scan(spark, sf_dir).collect()
    assert len(got) == len(texts) and sum(r["n_assign"] + r["n_access"] + r["n_hex"] for r in got) > 0
    for r in got:
        want = brute(texts[r["doc_id"]])
        line = ",".join(f"{list(BASE)[k]}:{s}:{e}" for s, k, e in want)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == x for _, k, _ in want) for x in range(3))


def test_tails_are_linear():
    """Header lines of 1 MB, without an END line, and thousands of headers that each see the same lines."""
    import time

    head, field = "-----BEGIN PRIVATE KEY-----", "\nProc-Type: "
    texts = [head + field + "A" * 1_000_000, head + "A" * 1_000_000, head + "\n" + "A" * 1_000_000 + "-", "-----BEGIN " + "A" * 1_000_000]
    texts.append("".join(f"{head}{field}" for _ in range(8000)) + "\n!")
    scanner = Scanner()
    began = time.perf_counter()
    found = scanner.scan([t.encode() for t in texts])
    assert time.perf_counter() - began < 8
    assert [len(x) for x in found] == [1, 1, 1, 0, 8000]
    assert found[0][0][2] == len(head) and found[2][0][2] == len(head) + 1_000_001
    pem = [k for k, r in enumerate(RULES) if r[0] == "pem"][0]
    joined = re.compile(RULES[pem][1] + either("pem"))
    rng = random.Random(8)
    parts = [head, "-----END PRIVATE KEY-----", "\n", "\r\n", field, "A" * 40, "b+/=", " ", "-", "Key: -----END RSA PRIVATE KEY-----", "é"]
    for _ in range(3000):
        text = head + "".join(rng.choices(parts, k=rng.randrange(12)))
        want = [(m.start(), m.end()) for m in joined.finditer(text)]
        assert [(s, e) for s, k, e in scanner.scan([text.encode()])[0] if k == pem] == want, text
