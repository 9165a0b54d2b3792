"""Main text of pages, the prefix trie and the repair of conversations against plain versions."""

from __future__ import annotations

import hashlib
import html
import math
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest

from lodestone.llm import html_text, prefix_trie, turn_repair
from lodestone.llm.common import Workspace

SF = "/root/testdata/sf0.001"
BLANKS = " \t\n\x0b\x0c\r"
TURN = "conv_id long, turn long, role string, text string, digest string, part int, _part int, words string"


# ---------------------------------------------------------------- pages


def template_text(page: str) -> str:
    """The article of the test table's own template, by patterns."""
    article = re.search(r"<article>(.*?)(</article>|<footer|$)", page or "", re.S)
    if not article:
        return ""
    lines = re.sub("<[^>]+>", "", re.sub("<br>", " ", re.sub("</?(?:p|h1)>", "\0", article[1]))).split("\0")
    return "\n".join(" ".join(html.unescape(line).split()) for line in lines if line.strip())


def test_pages_of_the_table(spark):
    rows = {r.page_id: r for r in html_text.op11_html_text(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(rows) == len(pages)
    for page in pages:
        found = rows[page.page_id]
        assert found.text == template_text(page.html)
        assert (found.url, found.n_chars) == (page.url, len(found.text))


def paragraph(seed: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice("lorem ipsum dolor sit amet elit sed do tempor".split()) for _ in range(40)) + "."


@pytest.mark.parametrize(
    "page",
    [
        "<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><main>{0}</main><aside>{1}</aside>",
        '<body class="has-sidebar"><div id="cookieNotice"><p>{1}</p></div><div class="page sidebar-right"><article>{0}'
        '<form><label>Mail</label><input></form></article><div class="comments"><article><p>{1}</p></article></div></div>',
        '<div class="menu">One Two</div><div class="post-content">{0}<div class="ad">{1}</div></div><div id=footer>{1}</div>',
        "<div>About us</div><div>{0}</div><div>All rights reserved</div>",
        '<div>{0}</div><ul><li><a href=1>Some other page</a><li><a href=2>Another</a><li><a href=3>Third</a></ul>',
        '<section id="comments"><p>{1}</p></section><div role="main">{0}</div><div style="display:none">{1}</div>',
        "<script>var x = '<p>{1}</p>';</script><style>p {{}}</style><article>{0}</article><noscript>{1}</noscript><!-- {1} -->",
        "<nav><ul><li><a href=x>a<li><a href=y>b</ul><article>{0}<footer>{1}",
    ],
)
def test_what_surrounds_an_article(page):
    body = "<h1>A &amp; B</h1>" + "".join(f"<p>{paragraph(i)}\n <b>bold</b></p>" for i in range(4))
    want = "\n".join(["A & B", *(f"{paragraph(i)} bold" for i in range(4))])
    assert html_text.main_text(page.format(body, "Nobody wants this text here"))[0] == want


def test_odd_pages(spark):
    deep = "<div>" * 5_000 + "deep"
    rows = [
        (1, None, None), (1, "u", ""), (2, "u", "   "), (2, "u", "   "), (3, "u", "plain &lt;text&gt; &amp;&nbsp;more"),
        (4, "u", deep), (5, "u", "<p>" + "long words " * 200_000), (6, "u", "<p>a < b</p><p>c > d"), (None, "u", "<p>x<br>y"),
        (7, "u", "<p>cut off <a hre"), (8, "u", "<table><tr><td>a<td>b<tr><td>c</table>"), (9, "u", "<b><p>one</b><p>two</i>"),
    ]
    pages = spark.createDataFrame([(*r, "t", 3.0) for r in rows], "page_id long, url string, html string, text string, density_sum double")
    found = html_text.extract_main_text(pages)
    texts = sorted(((r.page_id or 0, r.text) for r in found.collect()), key=lambda r: (r[0], len(r[1])))
    assert [t for _, t in texts if len(t) < 100] == [
        "x y", "", "", "", "", "plain <text> & more", "deep", "a < b\nc > d", "cut off", "a\nb\nc", "one\ntwo",
    ]
    assert max(len(t) for _, t in texts) == len("long words ") * 200_000 - 1
    assert html_text.extract_main_text(pages.limit(0)).count() == 0


def random_tree(draw: random.Random, depth: int):
    if depth == 0 or draw.random() < 0.3:
        return "w" * draw.randrange(1, 9)
    return (draw.choice(["div", "section", "span", "a"]), [random_tree(draw, depth - 1) for _ in range(draw.randrange(1, 4))])


def test_densities_against_recursion():
    draw = random.Random(5)
    for _ in range(60):
        tree = ("div", [random_tree(draw, 4), random_tree(draw, 3)])

        def inside_link(node, linked=False):
            """Nested links end each other, so trees have none."""
            if isinstance(node, str):
                return node
            tag = "span" if linked and node[0] == "a" else node[0]
            return tag, [inside_link(n, linked or tag == "a") for n in node[1]]

        tree = inside_link(tree)

        def page(node):
            return node if isinstance(node, str) else f"<{node[0]}>" + "".join(map(page, node[1])) + f"</{node[0]}>"

        def count(node, linked=False):
            if isinstance(node, str):
                return [len(node), 0, len(node) * linked, 0]
            linked = linked or node[0] == "a"
            total = [0, 0, 0, 0]
            for child in node[1]:
                c, t, lc, lt = count(child, linked)
                tag = not isinstance(child, str)
                total = [total[0] + c, total[1] + t + tag, total[2] + lc, total[3] + lt + (tag and child[0] == "a")]
            return total

        whole = count(("body", [tree]))
        wanted = []

        def weigh(node, linked=False):
            c, t, lc, lt = (max(x, 1) for x in count(node, linked))
            other = max(count(node, linked)[0] - count(node, linked)[2], 1)
            base = math.log(c / other * lc + whole[2] / whole[0] * c + math.e)
            wanted.append(c / t * math.log(c / lc * t / lt) / math.log(base) if c * t > lc * lt else 0.0)
            for child in node[1]:
                if not isinstance(child, str):
                    weigh(child, linked or node[0] == "a")

        weigh(("body", [tree]))
        parsed = html_text.parse(page(tree))
        assert html_text.densities(parsed, [False] * len(parsed.tag))[3] == pytest.approx(wanted)


# ---------------------------------------------------------------- conversations


def talk(seed: int, convs: int, words: str = "ab", longest: int = 6) -> list[tuple]:
    """Conversations of few different turns, so that many share their beginnings."""
    draw, rows = random.Random(seed), []
    for conv in [*range(-3, convs), 40_000, 40_001]:
        for turn in range(draw.randrange(0, longest)):
            role = draw.choice(["user", "assistant", None, "system"][: 2 + seed % 3])
            rows.append((conv, None if draw.random() < 0.05 else turn, role, draw.choice([*words, "", None, "x y. "])))
    return rows


def turn_table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, 2, "w") for r in rows], TURN)


def plain_trie(rows: list[tuple]) -> set[tuple]:
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is None:
            continue
        role, text = role or "", text or ""
        digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
        turns[conv].append(((turn is not None, turn or 0), digest, (role, text)))
    own = {c: [t for *_, t in sorted(ts)] for c, ts in turns.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + ts[h:]
    members = defaultdict(list)
    for c, ts in sorted(built.items()):
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        children[node[:-1]] += bool(node)
    for node, inside in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(inside) - 1) * words
    return {
        (
            inside[0], len(node), members[node[:-1]][0] if node else None, len(inside), children[node], leaves[node],
            saved[node], hashlib.sha256(",".join(str(c) for c in inside if len(built[c]) == len(node)).encode()).hexdigest(),
        )
        for node, inside in members.items()
    }


@pytest.mark.parametrize(("seed", "segment", "rows"), [(0, 64, 1 << 15), (1, 64, 5), (2, 2, 7), (3, 1, 11), (4, 2, 1 << 15)])
def test_trie(spark, monkeypatch, seed, segment, rows):
    monkeypatch.setattr(prefix_trie, "SEGMENT", segment)
    monkeypatch.setattr(prefix_trie, "RANGE_ROWS", rows)
    table = talk(seed, 60, "ab"[: 1 + seed % 2])
    table += [(None, 1, "user", "a"), (7, 2, "user", "a"), (7, 2, "user", "a")]
    # Two equal conversations that are longer than the others, and one of many turns of its own.
    table += [(c, t, "user", f"same {t}") for c in (400, 401, 403) for t in range(9)]
    table += [(500, t, "user", f"own {t % 7}") for t in range(200)]
    turns, whole = prefix_trie.rebuild(prefix_trie.turn_rows(turn_table(spark, table)))
    found = [tuple(r) for r in prefix_trie.prefix_trie(turns, whole, Workspace(spark, "trie")).collect()]
    wanted = plain_trie(table)
    assert len(found) == len(wanted)
    assert set(found) == wanted


def test_trie_without_conversations(spark):
    turns, whole = prefix_trie.rebuild(prefix_trie.turn_rows(turn_table(spark, [])))
    assert prefix_trie.prefix_trie(turns, whole, Workspace(spark, "trie")).count() == 0


def plain_repair(rows: list[tuple]) -> dict:
    """Every edit of every turn tried, whole audits compared."""
    talks: dict = defaultdict(list)
    for c, t, r, x in rows:
        talks[c]
        r, x = " " if r is None else r, " " if x is None else x
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind == 0:
            continue
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        r = "user" if kind == 4 else r
        digest = hashlib.md5(f"{len(r)}:{r}{x}".encode()).hexdigest()
        talks[c] += [((t is not None, t or 0), digest, t, r, x)] * (2 if kind == 3 else 1)
    return {c: plain_repair_of(sorted(ts, key=lambda v: v[:2])) for c, ts in talks.items()}


def plain_repair_of(turns: list[tuple]) -> tuple:
    seen, faults = set(), []
    for *_, r, x in turns:
        left = x.strip(BLANKS)
        faults.append("b" if not left else "d" if (r, x) in seen else "t" if left[-1] not in ".!?" else "k")
        seen.add((r, x))
    numbers = [t for _, _, t, _, _ in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[3][:1] + b[3][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    n, follow = len(turns), {"": "u", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def best(i: int, last: str, inserted: int):
        found = [(0, "", ())] if i == n and last in ("", "a") else []

        def edit(cost, letter, line, *after):
            rest = best(*after)
            if rest:
                found.append((cost + rest[0], letter + rest[1], line + rest[2]))

        role = follow[last]
        name = {"u": "user", "a": "assistant"}[role]
        if i < n:
            *_, r, x = turns[i]
            edit(4, "D", (), i + 1, last, inserted)
            if faults[i] not in "bd":
                more = 3 * (faults[i] == "t")
                if last == "" and r[:1] == "s":
                    edit(more, "K", (f"{r}:{x}",), i + 1, "s", inserted)
                if r[:1] == role:
                    edit(more, "K", (f"{r}:{x}",), i + 1, role, inserted)
                else:
                    edit(more + 3, "R", (f"{name}:{x}",), i + 1, role, inserted)
        if inserted < n + 3:
            edit(3, "I", (f"{name}:",), i, role, inserted + 1)
        return min(found) if found else None

    cost, audit, lines = best(0, "", 0)
    return (
        gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit,
        hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def repaired(conversations, spark) -> dict:
    rows = turn_repair.damage(conversations)
    return {r.conv_id: tuple(r)[1:] for r in turn_repair.repair(conversations, rows, Workspace(spark, "repair")).collect()}


@pytest.mark.parametrize(("chunk", "piece"), [(32, 1 << 16), (3, 4), (1, 1)])
def test_repair(spark, monkeypatch, chunk, piece):
    monkeypatch.setattr(turn_repair, "CHUNK", chunk)
    monkeypatch.setattr(turn_repair, "PIECE", piece)
    table = talk(chunk, 60, "ab", 9) + [(None, 1, "user", "a."), (7, 2, "user", "a."), (7, 2, "user", "a."), (8, None, None, None)]
    table += [(9, t, ("user", "assistant", "tool", "")[t % 3], f"t{t % 11}" + "." * (t % 2)) for t in range(0, 60, 3)]
    assert repaired(turn_table(spark, table), spark) == plain_repair(table)
    assert repaired(turn_table(spark, []), spark) == {}


def test_repair_of_the_table_and_of_a_long_conversation(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    found = {r.conv_id: tuple(r)[1:] for r in turn_repair.op13_turn_repair(spark, SF).collect()}
    assert found == plain_repair(rows)
    draw = random.Random(2)
    long = "".join(draw.choice("8c8c8c8c89cdae4") for _ in range(50_000))
    cost, audit = turn_repair.align(long)
    assert len(audit) - audit.count("I") == len(long)
    assert cost == sum({"D": 4, "I": 3, "R": 3, "K": 0}[e] for e in audit) + 3 * sum(
        e != "D" and int(c, 16) % 4 == 1 for e, c in zip(audit.replace("I", ""), long, strict=True)
    )


@pytest.mark.parametrize("chunk", [1, 3, 32])
def test_alignment(monkeypatch, chunk):
    monkeypatch.setattr(turn_repair, "CHUNK", chunk)
    draw = random.Random(chunk)

    @lru_cache(None)
    def best(codes: str, state: int, inserted: int):
        role, after = (2, 2, 3, 2)[state], (2, 2, 3, 2)[state]
        found = [(0, "")] if not codes and state in (0, 3) else []
        moves = []
        if codes:
            have, fault = divmod(int(codes[0], 16), 4)
            moves.append((4, "D", codes[1:], state, inserted))
            if fault < 2:
                if state == 0 and have == 1:
                    moves.append((3 * fault, "K", codes[1:], 1, inserted))
                moves.append((3 * fault + 3 * (have != role), "KR"[have != role], codes[1:], after, inserted))
        if inserted < 8:
            moves.append((3, "I", codes, after, inserted + 1))
        for cost, letter, *rest in moves:
            if (behind := best(*rest)) is not None:
                found.append((cost + behind[0], letter + behind[1]))
        return min(found) if found else None

    for k in range(1500):
        codes = "".join(draw.choice(turn_repair.CODES if k % 2 else "4589cd8c8c") for _ in range(draw.randrange(8)))
        assert turn_repair.align(codes) == best(codes, 0, 0)
