import re

import pytest
from pyspark.sql import functions as F

from lodeseam.functions import text as t
from lodeseam.functions import vocab
from lodeseam.operators import chunking


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def split_long(lines, budget):
    est = lambda s: max(1, int(len(s.split()) * 1.33))
    groups, cur, n = [], [], 0
    for line in lines:
        if cur and n + est(line) > budget and not line.strip():
            groups.append(cur)
            cur, n = [], 0
        else:
            cur.append(line)
            n += est(line)
    out = []
    for g in groups + ([cur] if cur else []):
        words = "\n".join(g).split()
        out += ["\n".join(g)] if est("\n".join(g)) <= budget else [" ".join(words[i : i + int(budget / 1.33)]) for i in range(0, len(words), int(budget / 1.33))]
    return out


def sequential(text, budget):
    """The semantics as a plain loop over lines."""
    out, buf, stack, fence = [], [], [], False

    def flush(kind, split=False):
        joined = "\n".join(buf)
        parts = split_long(buf, budget) if split and max(1, int(len(joined.split()) * 1.33)) > budget else [joined]
        out.extend((p.strip(), kind, tuple(x for _, x in stack)) for p in parts if p.strip())
        buf.clear()

    for line in text.splitlines():
        m = re.match(r"^(#{1,6})\s+(.*?)\s*#*\s*$", line)
        if line.strip().startswith("```"):
            if fence:
                buf.append(line)
                flush("code")
            else:
                flush("text")
                buf.append(line)
            fence = not fence
        elif fence:
            buf.append(line)
        elif m:
            flush("text")
            while stack and stack[-1][0] >= len(m[1]):
                stack.pop()
            stack.append((len(m[1]), m[2].strip()))
            buf.append(line)
        elif not line.strip():
            flush("text", True)
        else:
            buf.append(line)
    flush("code" if fence else "text", True)
    return out


def test_markdown_against_a_plain_loop(spark):
    import random

    rng = random.Random(3)
    pieces = ["# Top", "## Mid ##", "### Low", "", "  ", "```py", "```", "some words here", "w " * 30, "#nospace", "é text\u2028more", "   ``` x"]
    rows = [(k, "\n".join(rng.choice(pieces) for _ in range(rng.randint(0, 25)))) for k in range(120)] + [(900, None), (901, "")]
    got = {}
    for r in chunking.markdown_chunks(spark.createDataFrame(rows, "doc_id long, text string"), budget=20).orderBy("doc_id", "ordinal").collect():
        got.setdefault(r.doc_id, []).append((r.text, r.kind, tuple(r.section_path)))
    for k, text in rows:
        assert got.get(k, []) == (sequential(text, 20) if text else []), text


def test_breadcrumbs(spark):
    df = spark.createDataFrame([(1, "# Root\n\nintro\n\n## Top\n\n### Sub\n\ndeep\n\n## Next\n\nx", ["Cat"])], "doc_id long, text string, p array<string>")
    rows = chunking.markdown_chunks(df, path_col="p").orderBy("ordinal").collect()
    assert [list(r.section_path) for r in rows if r.text in ("deep", "x")] == [["Cat", "Root", "Top", "Sub"], ["Cat", "Root", "Next"]]


def test_scalars(spark):
    lit = F.lit
    assert one(spark, t.token_estimate(lit("a b c"))) == 3 and one(spark, t.token_estimate(lit(""))) == 1
    assert one(spark, t.normalized(lit("Hé, Wörld-2!"))) == "h w rld 2"
    assert one(spark, t.shingles(lit("a b"))) == ["a b"] and one(spark, t.shingles(lit("--"))) == []
    assert one(spark, t.jaccard(t.shingles(lit("a b c d")), t.shingles(lit("a b c e")))) == pytest.approx(1 / 3)
    assert one(spark, t.query_tokens(lit("As-Rep a.b as-rep _x +"))) == ["as-rep", "a.b", "x"]
    assert one(spark, t.humanize(lit("o'neil-2nd_page x1y"))) == "o'neil-2nd_page x1y".replace("-", " ").replace("_", " ").title()
    assert one(spark, t.strip_front_matter(lit("---\na: 1\n---\n\n# T\n"))) == "# T\n" and one(spark, t.strip_front_matter(lit("--- no"))) == "--- no"
    assert one(spark, t.markdown_title(lit("\n\n# The Title \nx"))) == "The Title" and one(spark, t.markdown_title(lit("x\n# T"))) is None
    assert tuple(one(spark, t.title_split(lit("HackTheBox - Helix")))) == ("Helix", "htb") and tuple(one(spark, t.title_split(lit("Helix")))) == (None, "unknown")
    assert one(spark, t.snippet(lit("x" * 500 + " needle " + "y" * 500), lit("needle"))).startswith("…x")
    assert one(spark, t.index_tokens(lit("Éa_b Ünï-2"))) == ["ea", "b", "uni", "2"]
    assert one(spark, t.json_list(lit("nope"))) == [] and one(spark, t.json_list(lit('["a"]'))) == ["a"]
    assert one(spark, vocab.resolve_technique(lit("  Pass  THE hash"))) == "pass the hash" and one(spark, vocab.resolve_technique(lit("x"))) is None
    s = one(spark, vocab.signals(lit("Kerberoasting over SMB with rpcclient")))
    assert (s.service, s.technique, s.tool) == (["kerberos", "rpc", "smb"], ["kerberoasting"], ["rpcclient"]) or "smb" in s.service


def test_structured_pages(spark):
    rows = [("d", 1, "a\n\nb", ["H1", "x"], ["code", "code", "z"]), ("d", 2, "c " * 500, None, None), ("d", 3, None, ["H2"], [])]
    df = spark.createDataFrame(rows, "doc string, page int, text string, h array<string>, c array<string>")
    out = [(r.page, r.kind, list(r.section_path), r.text[:9]) for r in chunking.page_chunks(df, "doc", "page", headings_col="h", code_col="c").orderBy("ordinal").collect()]
    assert out == [(1, "text", ["H1"], "a\nb"), (1, "code", ["H1"], "```\ncode\n"), (1, "code", ["H1"], "```\nz\n```"), (2, "text", ["H1"], "c c c c c")]
