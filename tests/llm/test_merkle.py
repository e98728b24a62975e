import hashlib
from collections import Counter

from hypothesis import given
from hypothesis import strategies as st

from corpusmill.llm import merkle, queries


@given(st.text(alphabet="ab.! \n\té😀", max_size=1500))
def test_leaves_hold_the_text(text):
    assert "".join(merkle.leaves(text)) == text
    assert all(len(x) <= merkle.LEAF for x in merkle.leaves(text))


def test_likeness():
    one = "A b c. " * 20 + "".join(f"Sentence number {i}. " for i in range(40))
    other = one.replace("number 7.", "number seven.")
    a, b = merkle.fingerprint(one), merkle.fingerprint(other)
    assert merkle.likeness(a, a) == 1 and 0.9 < merkle.likeness(a, b) < 1
    assert len(merkle.edits(a, b)) == 1 and merkle.edits(a, a) == []
    assert merkle.likeness(merkle.fingerprint(""), a) == 0 and merkle.likeness(merkle.fingerprint(""), merkle.fingerprint("")) == 1


def brute_tree(text):
    """Sections of paragraphs of leaves, as lists of texts."""
    paragraphs, own = [], []
    for leaf in merkle.leaves(text):
        own.append(leaf)
        if leaf.endswith("\n"):
            paragraphs.append(own)
            own = []
    paragraphs += [own] if own else []
    return paragraphs


@given(st.text(alphabet="ab.! \n\té", max_size=600), st.text(alphabet="ab.! \n\té", max_size=600))
def test_roots_tell_texts_apart_and_follow_from_their_branches(one, other):
    a, b = merkle.fingerprint(one), merkle.fingerprint(other)
    assert merkle.holds(a) and merkle.holds(b)
    assert (a == b) == (one == other) == (a[:32] == b[:32])
    leaf = lambda t: hashlib.blake2b(t.encode(), digest_size=16, person=b"leaf").hexdigest()
    assert [own for _, ps in merkle.branches(a) for _, own in ps] == [[leaf(t) for t in p] for p in brute_tree(one)]
    x, y = Counter(merkle.leaves(one)), Counter(merkle.leaves(other))
    most = max(x.total(), y.total())
    near = merkle.likeness(a, b)
    assert near == merkle.likeness(b, a) and 0 <= near <= 1
    assert one == other or near == ((x & y).total() / most if most else 0.0)
    assert one != other or merkle.edits(a, b) == []


def test_a_tampered_fingerprint_does_not_hold():
    own = merkle.fingerprint("One. Two.\n\nThree. " * 5)
    assert not merkle.holds(own[:40] + ("0" if own[40] != "0" else "1") + own[41:])


def test_edits_are_located_in_section_paragraph_and_leaf():
    one = "Alpha one. Alpha two.\nBeta one. Beta two. Beta three.\n\nGamma.\n"
    a, b = merkle.fingerprint(one), merkle.fingerprint(one.replace("Beta two", "Beta 2"))
    (section, paragraph, leaf), = merkle.edits(a, b)
    assert merkle.branches(a)[section][1][paragraph][1][leaf] == merkle.digest(b"leaf", b"Beta two. ").hex()
    assert leaf == 1


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for i, (doc, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        out.append((doc or 0, len(text), hashlib.sha256(edited.encode()).hexdigest(), merkle.fingerprint(text), merkle.likeness(merkle.fingerprint(text), merkle.fingerprint(edited)), merkle.likeness(merkle.fingerprint(text), merkle.fingerprint(after))))
    return sorted(out)


def told(df):
    from pyspark.sql import functions as F

    return sorted((r["doc_id"] or 0, r["n_chars"], r["s"], r["fingerprint"], r["near_edited"], r["near_next"]) for r in df.withColumn("s", F.sha2("edited", 256)).collect())


def test_next_document(spark):
    rows = [(i * 7 % 101, f"Text {i}. Ünd 😀 more {i * i}. " * (i % 5)) for i in range(101)] + [(5, "same"), (5, "same"), (5, "also"), (None, "null id"), (200, None), (201, "z" * 100_000)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, part string").repartition(5)
    for per in (1024, 10, 1):
        assert told(merkle.edited_pairs(docs, per)) == brute(rows)
    assert told(merkle.edited_pairs(docs.limit(0))) == []
    assert told(merkle.edited_pairs(docs.where("doc_id = 200"))) == brute([(200, None)])


def test_large_ids_beside_nulls_and_hot_ids(spark):
    rows = [(2**60 + 300 * i, f"text {i}. more") for i in range(200)] + [(None, f"null {i % 7} {i}") for i in range(40)] + [(7, f"{i:03} repeated") for i in range(60)] + [(2**63 - 1, "last"), (-(2**63), "first")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for per in (8, 32):
        assert told(merkle.edited_pairs(docs, per)) == brute(rows)
    parts = merkle.with_next(docs, 8).where("place = 0").groupBy("part").count().agg({"count": "max"}).first()[0]
    assert parts <= 40


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    out = queries.op10_merkle(spark, "/root/testdata/sf0.001").collect()
    want = {r[0]: r[2] for r in brute([tuple(r) for r in docs.collect()])}
    assert {r["doc_id"]: r["edited_sha256"] for r in out} == want
