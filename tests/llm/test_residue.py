import random
import re

import numpy as np
import pytest

from tests.conftest import rows
from tracewell.llm import residue as R
from tracewell.llm import residue_rules
from tracewell.llm.residue_rules import ALONE, read, trusted


def shown(text):
    evident, passages = read(text)
    return evident or bool(trusted(passages))


YES = [
    "Dear {{ name }}, your order was ready.", "The owner of this token is {%profile%}.", "Welcome to <YOUR_PROJECT>, the tool.", "Copyright [year goes here] [name goes here].", "Ask [Your team name] first.", "Contact: [object Object]", "# ${projectName}",
    "It was built by %BUILD_USER%.", "This release of %(name)s fixes it.", "See @@VERSION_ID@@ for more.", "It is kept by [[ owner.name ]].", "The owner is ((team_name)).", "The owner is «team_name».", "Install <insert package> first.", "Made by {0}.", "By __AUTHOR_NAME__.",
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "foo bar baz.", "Blah blah blah.", "Your content goes here.", "Dies ist ein Blindtext.", "Texto de ejemplo. Aquí irá la descripción.", "asdf qwer zxcv hjkl asdf", "xxxx xx xxxxx xxx xxxx.",
    "404 Not Found", "Page cannot be displayed.", "Access denied", "HTTP Status 410 - Gone", "Seite nicht gefunden.", "Error 404: la página que buscas no existe.", '{"error": {"code": 500, "message": "x"}}', "Menu\n\nNobody could find this page.", "Страница не найдена.", "页面不存在或已被删除。",
    "HTTP 502 that is not here", "Fehler 500. gateway did not answer in time", "Error 502: gateway did not answer in time", "You may not open this revision. It may have been renamed or removed.", "Vestum quorum larem aquor tullare divet urna cendit elit.",
    "Please enable JavaScript to view this page.", "This viewer does not work without scripting. Switch it on.", "Activez JavaScript pour afficher ce contenu.", "Cookies and scripting are required.", "请启用脚本后再访问本页。",
]
NO = [
    None, "", "  \n", "The renderer writes {{ name }} wherever the name is to appear.", "GET /v1/docket/{docket_id}/payload returns the payload; {docket_id} is an integer.", "The build replaces @@VERSION_ID@@ in the manifest by the commit.", "Shell scripts read ${HOME_DIR} at start, so export it.",
    'log.warning("%s: %(name)s lost 9", x) was replaced, since the format string mixed two styles.', "Our linter rejects filler such as lorem ipsum and explains it.", "Test names foo, bar and baz were renamed.", 'Fixed: "Please enable JavaScript" was shown even though it was on.',
    'If users report "Access denied", look at the token first.', "The handler answers 404 Not Found if the token is unknown.", "A 503 from the proxy means the pool ran out.", "The viewer works without JavaScript since release 9.", "TODO list for the x: measure it, then drop the delay.", "TODO", "// XXX", "Error 404 handling in the proxy was moved to the queue and now takes 9 seconds at most.",
    "for item in items:\n    print(f'{item}')", "Traceback (most recent call last):\n  File \"x.py\", line 9, in f\nValueError: not found", "Plain words about pages and files that were found.",
]


@pytest.mark.parametrize("text", YES)
def test_residue(text):
    assert shown(text)
    assert shown("Some title\n\n" + text)


@pytest.mark.parametrize("text", NO)
def test_no_residue(text):
    assert not shown(text)


@pytest.mark.parametrize(
    "text",
    [
        "400 Bad Request", "Your session has timed out.", "Your login has ended.", "The requested file does not exist", "Acceso denegado", "You do not have the right to view this document",
        "Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip.", "Excepteur sint occaecat cupidatat proident, sunt in culpa.", "zxc vbn zxc vbn", "This page cannot be dıſplayed", "İnternal server error",
    ],
)
def test_rules_without_a_common_word(text):
    assert shown(text)


def test_the_gate_passes_whatever_a_rule_matches():
    letters = set()
    for rule in residue_rules._SENTENCE:
        tree = residue_rules._parser.parse(rule.pattern, rule.flags)
        branches = tree[0][1][1] if len(tree) == 1 and tree[0][0] is residue_rules._parser.BRANCH else [tree]
        assert len(branches) > 5
        for branch in branches:
            needed = residue_rules._needed(branch)
            assert needed and min(map(len, needed)) >= 2
            letters.update("".join(needed))
    alike = re.compile("[" + re.escape("".join(sorted(letters))) + "]", re.I)
    assert {c for c in map(chr, range(0x110000)) if alike.fullmatch(c) and residue_rules._fold(c) not in letters} == set()
    for text in YES + NO:
        for sentence in (text or "").split("\n"):
            bits = residue_rules._rules(sentence)
            assert not any(rule.search(sentence) and not bits >> k & 1 for k, rule in enumerate(residue_rules._SENTENCE))


@pytest.mark.parametrize(
    "code",
    [
        "```\nx = 1\n```", "````md\n```\nx = 1\n```\n````", "```\nx = 1\n  ```", "  ```\nx = 1\n```", "```x``` is a span", "~~~ a`b\nx = 1\n~~~~", "```\rx = 1\r```", "```\r\nx = 1\r\n``` \r\n",
    ],
)
def test_residue_after_a_fence(code):
    end = "\r" if code.endswith("\r```") else "\n"
    assert shown(f"Title{end}{code}{end}Access denied")
    assert not shown("```\nAccess denied\n```\nAll is well.") and not shown("````\n```\nAccess denied\n````\nAll is well.")


D = "doc_id long, text string, component string, trusted string"


def docs(spark, *texts):
    return spark.createDataFrame([(i, t, "c", "t") for i, t in enumerate(texts, 1)], D)


def test_edges(spark):
    df = docs(spark, None, "", "  ", "Access denied", "Access denied", "fine words", "🙂🚀", "Lorem ipsum dolor sit amet elit. " * 5000).unionByName(spark.createDataFrame([(None, "Access denied", "", "")], D))
    assert rows(R.find_residue(df), "doc_id", "trusted") == [(4, True), (5, True), (8, True)]
    assert R.find_residue(df.limit(0)).count() == 0


def words(rng, n):
    return [rng.choice("abcdefghij") + str(rng.randint(0, 400)) for _ in range(n)]


def prose(rng, n):
    return " ".join(" ".join(words(rng, 9)).capitalize() + "." for _ in range(n))


NOTICE = "This viewer was made by the team and will not run without scripting switched on in here"


def test_labels_spread_to_near_duplicates(spark):
    rng = random.Random(3)
    alone = f"Viewer\n\n{NOTICE}."
    copy = prose(rng, 6) + f" {NOTICE}. " + prose(rng, 4)
    # One word of 17 differs at the end, so 12 of 14 shingles are shared.
    near = prose(rng, 6) + f" {NOTICE[:-4]}there. " + prose(rng, 4)
    far = prose(rng, 6) + " This wiki was built by some group and does not work without scripting enabled at all today. " + prose(rng, 4)
    quoted = prose(rng, 6) + f' The page says "{NOTICE}." ' + prose(rng, 4)
    fenced = prose(rng, 6) + f"\n```\n{NOTICE}.\n```\n" + prose(rng, 4)
    clean = prose(rng, 9)
    df = docs(spark, alone, copy, near, far, quoted, fenced, clean)
    assert rows(R.find_residue(df), "doc_id", "trusted") == [(1, True), (2, False), (3, False)]
    # Without the passage that stands alone nothing is named: the spread decides.
    assert R.find_residue(df.where("doc_id > 1")).count() == 0


def test_labels_spread_along_chains(spark):
    rng = random.Random(8)
    base = NOTICE.split() + words(rng, 44)
    texts = [f"{' '.join(base)}."]
    for at in (50, 40, 30):
        base[at] = "changed"
        texts.append(prose(rng, 6) + f" {' '.join(base)}. " + prose(rng, 3))
    sets = [set(R.shingle_hashes(p, {}).tolist()) for p in [texts[0], *(next(x for x in read(t)[1] if x.startswith("This viewer")) for t in texts[1:])]]
    alike = [[len(a & b) >= 0.8 * len(a | b) for b in sets] for a in sets]
    assert all(alike[k][k + 1] for k in range(3)) and not alike[0][3]
    assert rows(R.find_residue(docs(spark, *texts)), "doc_id", "trusted") == [(1, True), (2, False), (3, False), (4, False)]


def test_preselection_loses_no_near_duplicate(spark):
    rng = random.Random(11)
    letters = [a + b + c for a in "abcdefgh" for b in "aeiou" for c in "klmnprst"]
    base = [[rng.choice(letters) for _ in range(rng.randint(3, 60))] for _ in range(60)]
    other = [[w if rng.random() > 0.01 else "new" + w for w in b] for b in base]
    seeds = spark.createDataFrame([(" ".join(b),) for b in base], "text string")
    packed = np.packbits(R.shingle_table(seeds), bitorder="little").tobytes()
    asked = spark.createDataFrame([(i, " ".join(o) + ".") for i, o in enumerate(other)], "id long, text string").mapInArrow(R._passages, R._PASSAGES)
    got = {r["id"] for r in asked.select("id", "key", "places").mapInArrow(R._alike(packed), "id long, key long").collect()}
    sets = [[set(R.shingle_hashes(" ".join(x), {}).tolist()) for x in side] for side in (base, other)]
    want = {i for i in range(60) if len(sets[0][i] & sets[1][i]) >= 0.8 * len(sets[0][i] | sets[1][i])}
    assert want and want <= got


def test_shingles_of_many_passages_at_once():
    rng = random.Random(12)
    texts = ["", "one", "two words", *[" ".join(words(rng, n)) for n in (3, 4, 5, 6, 7, 40)], "!", "same same same same same same same"]
    h, sizes = R.passage_shingles(texts, {})
    for part, t in zip(np.split(h, np.cumsum(sizes)[:-1]), texts):
        assert np.array_equal(np.unique(part), R.shingle_hashes(t, {}))


def test_a_text_with_other_content_is_not_trusted():
    rng = random.Random(13)
    assert trusted(read("Access denied")[1]) and trusted(read("Menu\n\nAccess denied\n\nSign in\n\nBack")[1])
    evident, passages = read(prose(rng, ALONE) + "\n\nAccess denied")
    assert not evident and "Access denied" in passages and not trusted(passages)


def signed(spark, texts):
    tx = spark.createDataFrame(list(enumerate(texts, 1)), "rep long, text string")
    return tx, tx.mapInArrow(R._sign, "rep long, size int, sig array<long>")


def test_links_against_brute_force(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(60):
        base = words(rng, rng.randint(6, 200))
        texts.append(" ".join(base))
        for share in (0.005, 0.02, 0.05):
            other = [w if rng.random() > share else "new" + w for w in base]
            texts.append(" ".join(other))
    texts = list(dict.fromkeys(texts))
    memo: dict = {}
    sets = [set(R.shingle_hashes(t, memo).tolist()) for t in texts]
    want = {(i + 1, j + 1) for i in range(len(sets)) for j in range(i + 1, len(sets)) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    tx, judged = signed(spark, texts)
    got = set(rows(R.near_duplicates(tx, judged)))
    assert got <= want and len(got) >= 0.97 * len(want)
    split = set(rows(R.near_duplicates(tx, judged, block=8)))
    assert split <= want and len(split) >= 0.97 * len(want)


def test_a_dense_bucket_stays_connected(spark):
    rng = random.Random(5)
    base = words(rng, 300)
    texts = [" ".join(base[:k] + ["x%d" % k] + base[k:]) for k in range(0, 300, 2)]
    tx, judged = signed(spark, texts)
    found = list(range(len(texts) + 1))
    for i, j in rows(R.near_duplicates(tx, judged)):
        old, new = max(found[i], found[j]), min(found[i], found[j])
        found = [new if x == old else x for x in found]
    assert set(found[1:]) == {1}


def test_a_dense_bucket_keeps_the_classes_of_small_ones(spark):
    rng = random.Random(6)
    base = words(rng, 200)
    texts = [" ".join(base)]
    for i in range(499):
        other = list(base)
        for at in rng.sample(range(200), rng.randint(1, 4)):
            other[at] = f"new{i}x{at}"
        texts.append(" ".join(other))
    tx, judged = signed(spark, texts)
    # Every candidate of the tables verified by itself.
    memo: dict = {}
    sets = [R.shingle_hashes(t, memo) for t in texts]
    sig = np.array([R.signature(x) for x in sets])
    bits = np.unpackbits(sig.view("u1"), axis=1, bitorder="little")[:, : R.BANDS * R.BAND_BITS].reshape(len(texts), R.BANDS, R.BAND_BITS)
    label = list(range(1, len(texts) + 1))
    for i in range(len(texts)):
        meet = (bits[i + 1 :] == bits[i]).all(2).any(1) & (np.bitwise_count(sig[i + 1 :] ^ sig[i]).sum(1) <= R.MAX_HAMMING)
        for j in np.flatnonzero(meet) + i + 1:
            both = len(np.intersect1d(sets[i], sets[j]))
            if both >= R.SIMILARITY * (len(sets[i]) + len(sets[j]) - both) and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    want = [(i, x) for i, x in enumerate(label, 1) if label.count(x) > 1]
    found = list(range(len(texts) + 1))
    for i, j in rows(R.near_duplicates(tx, judged)):
        old, new = max(found[i], found[j]), min(found[i], found[j])
        found = [new if x == old else x for x in found]
    assert [(i, x) for i, x in enumerate(found) if found.count(x) > 1] == want
