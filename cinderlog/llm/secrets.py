r"""Secret scans: candidates by one pattern, false positives removed by a random forest.

A candidate is a private key block; or a run of 16 or more letters, digits, ``_ + / -`` with a digit in it,
or of 20 and more without (up to two ``=`` may end it, and parts of 16 and more may follow dots); or 8 and
more characters up to a space, quote or bracket as the value of a word that names a credential (``name = value``,
``name: "value"``). The forest sees its
length, its character classes and transitions, the part covered by dictionary words, the path of its
document, and the neighbouring words (up to CONTEXT characters on either side, the candidate before
among them, no further than the next). It is trained here on labelled findings: shapes of credentials in the places
where they leak, and look-alikes (digests, ids, paths, identifiers, placeholders) in theirs, cut by the
scan's own expressions. Training data are some thousand made-up rows of fixed number; shapes for a test of what was never
trained on are ``unseen``. The trees become one SQL expression, so scanning runs wholly in the JVM.

Defined results: null or empty text has no findings and stays as it is; equal rows give equal
findings, once per row; a null doc_id is carried; an empty table gives none; other columns, whatever
their names, pass through ``redact`` untouched (n_chars is counted anew if there).
"""

from __future__ import annotations

import random
import string

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlog.llm.stages import packed

#: What names a credential, as a value's left neighbour.
KEY_WORDS = "token|secret(?:[_-]?key)?|passwd|password|pwd|passphrase|api[_-]?key|access[_-]?key|auth[_-]?key|private[_-]?key|signing[_-]?key|credentials?"
_RUN = r"[A-Za-z0-9_+/\-]"
CANDIDATE = (
    r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----[A-Za-z0-9+/=\s\\:,\-]*?-----END [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
    rf"|(?<!{_RUN})(?:(?=[A-Za-z_+/\-]*[0-9]){_RUN}{{16,}}+|(?=[_+/\-]*[A-Za-z]){_RUN}{{20,}}+)(?:\.[A-Za-z0-9_\-]{{16,}}+)*(?:={{1,2}}(?![A-Za-z0-9_+/=\-]))?"
    rf"|(?<=[:=][ \t]{{0,2}}[\"'`]?)(?<=(?i:{KEY_WORDS})[\"'`]?[ \t]{{0,2}}[:=]{{1,2}}[ \t]{{0,2}}[\"'`]?)[^\s\"'`<>,;(){{}}\[\]]{{8,}}+"
)
CONTEXT, THRESHOLD, MASK = 60, 0.5, "[SECRET]"
TREES, DEPTH, LEAF, ROWS, SEED = 25, 6, 4, 60, 11

#: Frequent letter pairs, words of identifiers and prose, words that name a credential or a look-alike.
PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce".split()
DICTIONARY = (
    "about access account action address after agent algorithm application array auth author base before begin between block body build button cache call change channel check child class client "
    "code collection column command comment commit common component config connect content context control convert core count create current data database date default delete description device "
    "dialog directory document domain download edit element email empty enable error event example exception export field file filter find first folder font format frame from function generate "
    "global group handler hash header height home image import index info initial input insert install instance interface internal item java javascript key language layer layout length library "
    "license line link list load local location lock login main manager master memory menu message method model module month mouse move name network node note number object offset open operation "
    "option order output package page parameter parent password path pattern permission platform player point policy port position prefix print private process product profile project property "
    "provider proxy public query queue random read record region release remove render report request resource response result return role root route rule sample save schema scope screen script "
    "search secret section select sequence server service session setting shadow shape share simple size sort source space spec stack standard start state static status storage store stream "
    "string style submit support switch symbol system table target task template test text theme thread time title token tool total trace transaction transfer tree trigger type undefined update "
    "upload user util valid value variable vector version video view virtual visible wait warning watch week width window word work write year your"
).split()
NAMING = "token|secret|passw|pwd|passphrase|api.?key|access.?key|private.?key|auth|bearer|credential|signing.?key|client.?key|account.?key"
BENIGN = "commit|sha\\d*|hash|md5|checksum|digest|uuid|guid|revision|build|etag|fingerprint|blob|integrity|version|order|invoice|isbn|serial|trace|request|session.?id|id"
EMPTY = "example|sample|your|xxxx|changeme|placeholder|dummy|insert|redacted|0000000|1234567|abcdef0123"

FEATURES = {
    "len": "cast(length(cand) as double)",
    "block": "if(startswith(cand, '-----BEGIN '), 1.0, 0.0)",
    "dots": "regexp_count(cand, '[.]') / length(cand)",
    "valued": f"if(lower(before) rlike '({KEY_WORDS})[\"\\'`]?[ ]?[:=]{{1,2}}[ ]?[\"\\'`]?$', 1.0, 0.0)",
    "digits": "regexp_count(cand, '[0-9]') / length(cand)",
    "upper": "regexp_count(cand, '[A-Z]') / length(cand)",
    "marks": "regexp_count(cand, '[^A-Za-z0-9]') / length(cand)",
    "runs": "regexp_count(cand, '[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+') / length(cand)",
    "kinds": "size(array_distinct(split(cand, ''))) / least(length(cand), 40)",
    "hex": "if(cand rlike '^[0-9a-fA-F]+$', 1.0, 0.0)",
    "pairs": f"regexp_count(lower(cand), '{'|'.join(PAIRS)}') / length(cand)",
    "covered": f"1 - length(regexp_replace(lower(cand), '{'|'.join(sorted(DICTIONARY, key=lambda w: (-len(w), w)))}', '')) / length(cand)",
    "grouped": "if(cand rlike '^[0-9a-fA-F]+(-[0-9a-fA-F]+)+$', 1.0, 0.0)",
    "empty": f"if(lower(cand) rlike '{EMPTY}', 1.0, 0.0)",
    "slashes": "regexp_count(cand, '/') / length(cand)",
    "named": f"if(lower(before) rlike '({NAMING})[^\\\\n]{{0,24}}$', 1.0, 0.0)",
    "benign": f"if(lower(before) rlike '(^|[^a-z])({BENIGN})[^a-z0-9]{{0,6}}$', 1.0, 0.0)",
    "assigned": "if(before rlike '[:=][^A-Za-z0-9]{0,8}$', 1.0, 0.0)",
    "quoted": "if(before rlike '[\"\\'`]$' and after rlike '^[\"\\'`]', 1.0, 0.0)",
    "located": "if(before rlike '(://|[/.@#])[^ \\\\n]*$', 1.0, 0.0)",
    "tested": "if(lower(path) rlike 'test|example|sample|fixture|doc|mock', 1.0, 0.0)",
}


class _Made:
    """Made-up findings (before, finding, after, path, label) from one seed."""

    hexes, letters, alnum = "0123456789abcdef", string.ascii_letters, string.ascii_letters + string.digits
    b64, base58 = string.ascii_letters + string.digits + "+/", "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
    names = ("token", "secret", "password", "api_key", "apikey", "access_key", "auth_token", "client_secret", "passwd", "API_KEY", "private_key", "secretKey", "accessToken", "db_password")

    def __init__(self, seed: int) -> None:
        self.rng = random.Random(seed)

    def some(self, of: str, least: int, most: int = 0) -> str:
        return "".join(self.rng.choice(of) for _ in range(self.rng.randint(least, max(least, most))))

    def word(self) -> str:
        return self.rng.choice(DICTIONARY)

    def prose(self) -> str:
        return " ".join(self.some("aeionrstlhd", 2, 9) for _ in range(self.rng.randint(0, 5)))

    def path(self, label: int) -> str:
        plain = ["", "", f"src/{self.word()}.py", f"app/{self.word()}/{self.word()}.ts", f"deploy/{self.word()}.env"]
        trial = ["tests/test_auth.py", "docs/example.md", "fixtures/sample.json"]
        return self.rng.choice(plain * 6 + trial if label else plain + trial)

    def password(self) -> str:
        """As people make them: words or letters, a number, at times a mark."""
        parts = [self.rng.choice([self.word().title(), self.some(self.letters, 4, 8), self.some("aeionrstlhd", 4, 8).title()]) for _ in range(self.rng.randint(1, 2))]
        return "".join(parts) + self.rng.choice(["", self.some(string.digits, 1, 4)]) + self.rng.choice(["", "", *"!$@#%^&*?"]) + self.some(self.alnum, 2, 5)

    def assigned(self, value: str) -> tuple[str, str, str]:
        quote, gap = self.rng.choice(['"', "'", '"', ""]), self.rng.choice([" = ", "=", ": ", " : ", ":= ", '": '])
        name = self.rng.choice(self.names)
        return f"{self.prose()} {name.upper() if self.rng.random() < 0.2 else name}{gap}{quote}", value, f"{quote} {self.prose()}"

    def rows(self, labelled: list[tuple[int, list[tuple[str, str, str]]]]) -> list[tuple[str, str, str, str, int]]:
        return [(*x, self.path(label), label) for label, found in labelled for x in found]


def labelled_findings(seed: int = SEED) -> list[tuple[str, str, str, str, int]]:
    """(before, finding, after, path, label): made up, ROWS of each kind."""
    m, out = _Made(seed), []
    for _ in range(ROWS):
        some, word, prose, rng = m.some, m.word, m.prose, m.rng
        hexed = some(m.hexes, rng.choice([32, 40, 40, 48, 64]))
        values = [hexed.upper() if rng.random() < 0.2 else hexed, some(m.alnum, 20, 48), some(m.alnum, 10, 19), some(m.letters, 20, 40), some(m.b64, rng.choice([40, 44, 88])) + rng.choice(["", "=", "=="]), m.password(), m.password(),
                  "AKIA" + some(string.ascii_uppercase + string.digits, 16), "ghp_" + some(m.alnum, 36), "sk_live_" + some(m.alnum, 24), "xoxb-" + some(string.digits, 12) + "-" + some(m.alnum, 24), "glpat-" + some(m.alnum, 20)]
        jwt = ".".join(["eyJ" + some(m.alnum + "_-", 17, 40), "eyJ" + some(m.alnum + "_-", 30, 90), some(m.alnum + "_-", 43)])
        pem = "\n".join(some(m.b64, 64) for _ in range(rng.randint(3, 20)))
        kind = rng.choice(["", "RSA ", "EC ", "OPENSSH "])
        secrets = [m.assigned(v) for v in values] + [
            (f"{prose()} Authorization: Bearer ", some(m.alnum, 30, 60), f" {prose()}"), (f"{prose()} {rng.choice(['Bearer ', 'cookie: session=', 'jwt '])}", jwt, f" {prose()}"),
            (f"{prose()} postgres://{word()}:", some(m.alnum, 18, 28), f"@db.internal/{word()}"), (f"{prose()} ?{rng.choice(['access_token', 'api_key', 'token'])}=", some(m.alnum, 20, 40), f"&page={rng.randint(1, 9)} {prose()}"),
            (f"{prose()}\n", f"-----BEGIN {kind}PRIVATE KEY-----\n{pem}\n-----END {kind}PRIVATE KEY-----", f"\n{prose()}"),
        ]
        quote, gap = rng.choice(['"', "'", ""]), rng.choice([" = ", "=", ": "])
        look_alikes = [
            (f"{prose()} commit ", some(m.hexes, 40), f" {prose()}"), (f"{prose()} sha256: ", some(m.hexes, 64), f"\n{prose()}"), (f"{prose()} md5 = {quote}", some(m.hexes, 32), f"{quote} {prose()}"),
            (f"{prose()} {rng.choice(['id', 'uuid', 'request_id', 'trace'])}{gap}{quote}", "-".join(some(m.hexes, k) for k in (8, 4, 4, 4, 12)), f"{quote} {prose()}"),
            (f"{prose()} ", f"{word()}_{word()}_{word()}_{rng.randint(1, 99)}", f"({prose()}"), (f"{prose()} https://example.org/{word()}/", f"{word()}-{word()}-{word()}-{rng.randint(1, 9999)}", f" {prose()}"),
            (f"{prose()} ./", f"{word()}/{word()}2/{word()}/{word()}_{rng.randint(1, 9)}", f".{rng.choice(['py', 'js', 'so'])} {prose()}"), (f"{prose()} ", some(string.digits, 16, 20), f" {prose()}"),
            (f"{prose()} {rng.choice(m.names)}{gap}{quote}", rng.choice(["your_api_key_here_123", "EXAMPLE0000000000000000", "xxxxxxxxxxxxxxxx1234", "changeme1234567890", "insert_your_token_here1", "xxxxxxxx", "placeholder", "********", "changeme", "example-password"]), f"{quote} {prose()}"),
            (f"{prose()} {rng.choice(m.names)}{gap}", rng.choice([f"{word()}.{word()}.{word()}", f"os.environ.get", f"${word()}_{word()}", f"self.{word()}_{word()}", f"{word()}_{word()}", f"config.{word()}"]), f" {prose()}"),
            (f"{prose()} data:image/png;base64,", some(m.b64, 60, 200) + "1", f") {prose()}"), (f"{prose()} integrity={quote}sha512-", some(m.b64, 86) + "==", f"{quote} {prose()}"),
            (f"{prose()} ", some("aeionrstlhd", 14, 24) + rng.choice(["", str(rng.randint(0, 99))]), f", {prose()}"), (f"{prose()} invoice {rng.choice(['no. ', 'number ', '#'])}", some(string.digits, 16) + rng.choice(["", "A"]), f" {prose()}"),
            (f"{prose()} {rng.choice(m.names)} ", f"{word()}{word().title()}{word().title()}{rng.choice(['', str(rng.randint(1, 9))])}", f"() {prose()}"), (f"{prose()} ", f"{word()}{word().title()}{word().title()}{word().title()}", f"() {prose()}"),
            (f"{prose()} ", "-".join([word(), word(), word(), word()]), f" {prose()}"), (f"{prose()} ", f"{word()}/{word()}/{word()}/{word()}", f" {prose()}"), (f"{prose()} ", some("aeionrstlhd_", 24, 60), f" {prose()}"),
        ]
        out += m.rows([(1, secrets), (0, look_alikes)])
    return out


def unseen(seed: int = 5, rows: int = 40) -> list[tuple[str, str, str, str, int]]:
    """Findings of shapes and places that are in no training row."""
    m, out = _Made(seed), []
    for _ in range(rows):
        some, word, prose, rng = m.some, m.word, m.prose, m.rng
        secrets = [
            (f"{prose()} export HF_TOKEN=", "hf_" + some(m.alnum, 34), f"\n{prose()}"), (f"{prose()} \"shop_access_token\": \"", "shpat_" + some(m.hexes, 32), f"\" {prose()}"), (f"{prose()} AccountKey=", some(m.b64, 86) + "==", f";EndpointSuffix={word()}.net"),
            (f"{prose()} wallet secret: ", "5" + some(m.base58, 50), f" {prose()}"), (f"{prose()} mongodb+srv://{word()}:", some(m.alnum, 20, 24), f"@{word()}.{word()}.net/{word()}"), (f"{prose()} curl -H 'X-Api-Key: ", some(m.alnum, 32), f"' {prose()}"),
            (f"{prose()} <password>", some(m.alnum, 16, 24), f"</password> {prose()}"), (f"{prose()} npm //registry/:_authToken=", "npm_" + some(m.alnum, 36), f"\n{prose()}"), (f"{prose()} aws_secret_access_key = ", some(m.b64, 40), f"\n{prose()}"), (f"{prose()} login with password: '", m.password(), f"' {prose()}"),
        ]
        look_alikes = [
            (f"{prose()} image {word()}@sha256:", some(m.hexes, 64), f" {prose()}"), (f"{prose()} ETag: \"", some(m.hexes, 32), f"\" {prose()}"), (f"{prose()} blob/{some(m.hexes, 40)}/", f"{word()}/{word()}/{word()}2", f" {prose()}"),
            (f"{prose()} build ", f"{rng.randint(1, 9)}-{some(string.digits, 14)}-{word()}", f" {prose()}"), (f"{prose()} class=\"", f"{word()}-{word()}__{word()}--{word()}", f"\" {prose()}"), (f"{prose()} import ", f"{word()}_{word()}_{word()}_{word()}", f" {prose()}"),
            (f"{prose()} order ", f"{rng.randint(2000, 2030)}-{some(string.digits, 4)}-{some(string.digits, 8)}", f" {prose()}"), (f"{prose()} token = ", f"get_{word()}_{word()}", f"() {prose()}"), (f"{prose()} session-id ", "-".join(some(m.hexes, k) for k in (8, 4, 4, 4, 12)), f" {prose()}"), (f"{prose()} isbn ", some(string.digits, 13) + "-" + some(string.digits, 4), f" {prose()}"),
        ]
        out += m.rows([(1, secrets), (0, look_alikes)])
    return out


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int = DEPTH) -> tuple | float:
    """A tree: (feature, threshold, tree below or at it, tree above), or a leaf's share of label 1."""
    if depth == 0 or len(y) < 2 * LEAF or y.min() == y.max():
        return round(float(y.mean()), 4)
    best, cut = None, len(y) * 2 * y.mean() * (1 - y.mean())
    for f in rng.permutation(x.shape[1])[: max(2, int(x.shape[1] ** 0.5) + 1)]:
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        at = np.flatnonzero(v[1:] > v[:-1]) + 1
        at = at[(at >= LEAF) & (at <= len(y) - LEAF)]
        if not len(at):
            continue
        left, right = ones[at - 1], ones[-1] - ones[at - 1]
        impurity = 2 * left * (1 - left / at) + 2 * right * (1 - right / (len(y) - at))
        k = int(impurity.argmin())
        if impurity[k] < cut - 1e-9:
            cut, best = impurity[k], (int(f), round(float((v[at[k] - 1] + v[at[k]]) / 2), 6))
    if best is None:
        return round(float(y.mean()), 4)
    low = x[:, best[0]] <= best[1]
    return (*best, grow(x[low], y[low], rng, depth - 1), grow(x[~low], y[~low], rng, depth - 1))


def as_sql(tree: tuple | float, names: list[str]) -> str:
    if not isinstance(tree, tuple):
        return f"{tree}D"
    f, t, low, high = tree
    return f"CASE WHEN x.`{names[f]}` <= {t}D THEN {as_sql(low, names)} ELSE {as_sql(high, names)} END"


def features_sql(cand: str, before: str, after: str, path: str) -> str:
    """A struct of FEATURES over SQL expressions, each evaluated once."""
    fields = ", ".join(f"'{k}', cast({v.replace('cand', 'c.cand').replace('before', 'c.before').replace('after', 'c.after').replace('path', 'c.path')} as double)" for k, v in FEATURES.items())
    return f"transform(array(named_struct('cand', {cand}, 'before', {before}, 'after', {after}, 'path', coalesce({path}, ''))), c -> named_struct({fields}))[0]"


_forests: dict[int, list] = {}


def _cut(text: str) -> tuple[str, str]:
    """SQL of a text's candidates, and of what stands between them (one more)."""
    pattern = "'" + CANDIDATE.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"regexp_extract_all({text}, {pattern}, 0)", f"split({text}, {pattern}, -1)"


#: Of each candidate of ``cands`` and ``seps``: what stood before it (the candidate before among it), itself, and what follows.
_EACH = "transform(sequence(0, size(cands) - 1), i -> named_struct('p', if(i > 0, get(cands, i - 1), ''), 'sep', seps[i], 'cand', cands[i], 'n', seps[i + 1]))"


def _features(path: str) -> str:
    return features_sql("z.cand", f"substr(concat(z.p, z.sep), {-CONTEXT})", f"substr(z.n, 1, {CONTEXT})", path)


def found_in(rows: DataFrame) -> DataFrame:
    """Rows (b, t, a, p, y) to (x, y, cand): the features of the first candidate within the finding t, null where there is none."""
    cands, seps = _cut("text")
    cut = rows.selectExpr("concat(b, t, a) AS text", "length(b) AS lo", "length(b) + length(t) AS hi", "p", "y").selectExpr("*", f"{cands} AS cands", f"{seps} AS seps")
    ends = "transform(sequence(0, size(cands) - 1), i -> aggregate(slice(seps, 1, i + 1), 0, (n, s) -> n + length(s)) + aggregate(slice(cands, 1, i + 1), 0, (n, s) -> n + length(s)))"
    inside = "filter(transform(arrays_zip(parts, ends), z -> named_struct('z', z.parts, 'start', z.ends - length(z.parts.cand), 'end', z.ends)), w -> w.start < hi AND w.end > lo)"
    cut = cut.selectExpr("*", f"CASE WHEN size(cands) > 0 THEN {_EACH} END AS parts", f"CASE WHEN size(cands) > 0 THEN {ends} END AS ends").selectExpr("p", "y", f"get({inside}, 0).z AS z")
    return cut.selectExpr(f"CASE WHEN z IS NOT NULL THEN {_features('p')} END AS x", "y", "z.cand")


def forest(spark: SparkSession, seed: int = SEED) -> list:
    """Trees trained on the labelled findings; their features come from the same SQL as the scan's."""
    if seed not in _forests:
        rows = spark.createDataFrame(labelled_findings(), "b string, t string, a string, p string, y int")
        found = found_in(rows).where("x IS NOT NULL").collect()
        x, y = np.asarray([list(r["x"]) for r in found], float), np.asarray([r["y"] for r in found], float)
        rng = np.random.default_rng(seed)
        _forests[seed] = [grow(x[draw], y[draw], rng) for draw in (rng.integers(0, len(y), len(y)) for _ in range(TREES))]
    return _forests[seed]


def mean_sql(trees: list) -> str:
    """The share of trees for a secret, over features ``x``."""
    return "(" + " + ".join(as_sql(t, list(FEATURES)) for t in trees) + f") / {len(trees)}D"


def _scored(docs: DataFrame, path: str | None) -> DataFrame:
    """``row`` (all columns), seps, cands and parts: for each candidate the text before it, itself and its score; null for no candidate."""
    cands, seps = _cut("row.text")
    where = F.col(f"row.`{path}`").cast("string") if path else F.lit("")
    cut = packed(docs).select("row", F.expr(cands).alias("cands"), where.alias("path")).withColumn("seps", F.when(F.size("cands") > 0, F.expr(seps)))
    parts = f"transform({_EACH}, z -> named_struct('sep', z.sep, 'cand', z.cand, 'score', transform(array({_features('path')}), x -> {mean_sql(forest(docs.sparkSession))})[0]))"
    return cut.withColumn("parts", F.expr(f"CASE WHEN size(cands) > 0 THEN {parts} END"))


def scan(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per secret: doc_id, nth (of the text's candidates, from 1), start (code points from 1), secret, score."""
    found = _scored(docs, path).where("parts IS NOT NULL")
    sure = f"filter(transform(parts, (p, i) -> named_struct('i', i, 'cand', p.cand, 'score', p.score)), p -> p.score >= {THRESHOLD}D)"
    spans = f"transform({sure}, p -> named_struct('nth', p.i + 1, 'start', 1L + aggregate(slice(lengths, 1, p.i + 1), 0L, (a, b) -> a + b.sep) + aggregate(slice(lengths, 1, p.i), 0L, (a, b) -> a + b.cand), 'secret', p.cand, 'score', round(p.score, 6)))"
    found = found.withColumn("lengths", F.expr("transform(parts, p -> named_struct('sep', length(p.sep), 'cand', length(p.cand)))"))
    return found.select("row.doc_id", F.explode(F.expr(spans)).alias("f")).select("doc_id", "f.nth", "f.start", "f.secret", "f.score")


def redact(docs: DataFrame, path: str | None = None, mask: str = MASK) -> DataFrame:
    """The same rows and columns, with each secret in ``text`` replaced by ``mask``."""
    hidden = f"concat(array_join(transform(parts, p -> concat(p.sep, if(p.score >= {THRESHOLD}D, '{mask}', p.cand))), ''), element_at(seps, -1))"
    found = F.coalesce(F.exists("parts", lambda p: p["score"] >= THRESHOLD), F.lit(False))
    out = _scored(docs, path).select("row", found.alias("found"), F.when(found, F.expr(hidden)).otherwise(F.col("row.text")).alias("clean"))
    new = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("found"), F.length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
