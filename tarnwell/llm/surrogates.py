"""PII surrogates: entities get keyed replacements of the same type, format, script and gender.

E-mail addresses, telephone, card, account and national identity numbers and IP addresses are replaced by a keyed
permutation of all strings of the same format: a Feistel network numbers the format's strings in a secret order, and each
string gives way to the next one in it. Letters stay letters, digits stay digits, card numbers keep their issuer
digit and checksum. Permutations are one to one and move every string, so different originals never meet, and an original is
replaced alike in every document.

Names are found after a title, or from a given name of a list on, as up to four capitalised words (with hyphens, apostrophes,
initials and particles); the last is the family name. Each capitalised repeat of such a word in the same document is replaced too.
Names get names of the same gender and script from a pool by keyed hash. As a pool is finite, a check over all documents
finds names that share a replacement, or whose replacement some document has as an original; all but the first of the former
and all of the latter move on to others until all differ. A given name after a title without gender counts as of the gender
that it has elsewhere, in its own document first.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwell.llm.common import BROADCAST_ROWS, durable, rows_of

KINDS = ("email", "card", "account", "ssn", "phone", "ip", "given", "family")

EMAIL = re.compile(r"(?<![\w.+-])[\w.+-]*[\w+-]@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])")
IP = re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)", re.A)
CARD = re.compile(r"(?<![\w.-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4})(?![\w]|-\d)", re.A)
SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", re.A)
PHONE = re.compile(r"(?<![\w+.-])(?:(?:(?:\+\d{1,3}|[01])[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|(?:[01][ .-])?\d{3}[ .-]\d{3}[ .-]\d{4}|\+\d{1,3}(?:[ .-]?\d{2,4}){2,4})(?![\w-])", re.A)

#: Titles by gender; names must follow.
TITLES = {"Mr": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Señora": "f", "Dr": "u", "Prof": "u", "г-н": "m", "г-жа": "f"}
TITLE = re.compile(r"(?<!\w)(" + "|".join(TITLES) + r")\.?[ \xa0]")
#: A word that can be a name: letters, with hyphens and apostrophes inside, but for a possessive s.
WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+|['’](?![sS](?!\w))[^\W\d_]+)*")
#: What can stand between two name words: a space, with initials or particles.
BETWEEN = re.compile(r"[ \xa0](?:(?:[^\W\d_]\.|van|von|de|der|den|di|da|del|du|la|le|bin|al)[ \xa0])*")
MOST_WORDS = 4

#: Pools of replacement names by script and gender (u: either).
POOLS = {
    ("Latin", "m"): "Adam Bruno Carl Daniel Emil Felix Georg Hugo Ivan Jonas Karl Leo Martin Nils Oscar Paul Quentin Robert Simon Thomas Urban Victor Walter Xavier".split(),
    ("Latin", "f"): "Anna Bella Clara Diana Emma Flora Greta Hanna Irene Julia Karla Laura Maria Nora Olga Paula Rosa Sofia Tara Ursula Vera Wanda Xenia Yvonne".split(),
    ("Latin", "family"): "Abbot Barlow Carver Dalton Ellery Fenton Garner Hadley Irving Jarvis Kendal Lowell Marlow Norton Osgood Parker Quimby Radley Sutton Tilden Upton Vinson Weston Yardley".split(),
    ("Cyrillic", "m"): "Андрей Борис Виктор Григорий Дмитрий Евгений Иван Кирилл Леонид Максим Николай Олег Павел Роман Сергей Тимур".split(),
    ("Cyrillic", "f"): "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Ксения Лидия Мария Нина Ольга Полина Раиса Софья".split(),
    ("Cyrillic", "family"): "Аксаков Белов Волков Громов Дёмин Ершов Жуков Зимин Иванов Котов Лебедев Морозов Носов Орлов Павлов Рогов".split(),
    ("Greek", "m"): "Αλέξης Βασίλης Γιώργος Δημήτρης Θωμάς Κώστας Μάρκος Νίκος Πέτρος Στέλιος".split(),
    ("Greek", "f"): "Άννα Βέρα Γεωργία Δάφνη Ελένη Ζωή Κατερίνα Μαρία Σοφία Χριστίνα".split(),
    ("Greek", "family"): "Αγγέλου Βλάχος Γεωργίου Δήμου Ιωάννου Κανελλής Λάμπρου Μαρίνος Νικολάου Παππάς".split(),
}
GENDERS = {name.casefold(): g for (_, g), names in POOLS.items() if g in "mf" for name in names} | dict.fromkeys("john james william peter michael david".split(), "m") | dict.fromkeys("mary elizabeth susan linda sarah jane".split(), "f")
#: Listed given names, as they are written and in capitals.
GIVEN = [n.title() for n in GENDERS] + [n for (_, g), names in POOLS.items() if g in "mf" for n in names]
LISTED = frozenset(form for n in GIVEN for form in (n, n.upper()))
#: Words with a capital first, each looked up among the listed ones; far faster than one pattern of all names.
CAPITAL = re.compile(r"(?<![\w-])[A-ZÀ-ÞΆ-ΫЀ-Я][^\W\d_]+(?![\w'’])")


class Entity(NamedTuple):
    kind: str
    start: int
    end: int
    group: str
    """For names: script and gender of the replacement, as "Latin.f"; empty otherwise."""


def luhn(digits: str) -> int:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10


def script(word: str) -> str | None:
    """The one script of a word, if there are pools for it."""
    return next((name for name, r in SCRIPTS.items() if r.fullmatch(word)), None)


SCRIPTS = {name: re.compile(f"[{r}'’-]+") for name, r in {"Latin": "A-Za-zÀ-ɏ", "Cyrillic": "Ѐ-ӿ", "Greek": "Ͱ-Ͽἀ-῿"}.items()}


def name_words(text: str, at: int) -> list[tuple[int, int]]:
    """Up to MOST_WORDS name words in a row from a place on, each capitalised and of one script."""
    out: list[tuple[int, int]] = []
    while len(out) < MOST_WORDS:
        if out:
            gap = BETWEEN.match(text, at)
            if not gap:
                break
            at = gap.end()
        word = WORD.match(text, at)
        if not word or not word[0][0].isupper() or not script(word[0]):
            break
        out.append(word.span())
        at = word.end()
    return out


def names(text: str) -> list[Entity]:
    """Names after titles, and from listed given names on, as (given ..., family); overlaps are settled by ``find``."""
    out = []

    def add(words: list[tuple[int, int]], gender: str | None) -> None:
        *given, last = words
        if not given and text[slice(*last)].casefold() in GENDERS:
            given, last = [last], None
        for lo, hi in given:
            word = text[lo:hi]
            listed = GENDERS.get(re.split("['’-]", word.casefold())[0])
            out.append(Entity("given", lo, hi, f"{script(word)}.{listed if gender in (None, 'u') and listed else gender or 'u'}"))
        if last:
            out.append(Entity("family", *last, f"{script(text[slice(*last)])}.family"))

    if any(t in text for t in TITLES):
        for m in TITLE.finditer(text):
            at = m.end()
            while again := TITLE.match(text, at):  # Prof. Dr.
                at = again.end()
            if words := name_words(text, at):
                add(words, TITLES[m[1]])
    for m in CAPITAL.finditer(text):
        if m[0] in LISTED and len(words := name_words(text, m.start())) > 1:
            add(words, None)
    return out


def find(text: str | None) -> list[Entity]:
    """Entities by start, without overlaps: earlier kinds in KINDS win over later ones."""
    if not text:
        return []
    found: list[Entity] = []
    if "@" in text:
        found += [Entity("email", *m.span(), "") for m in EMAIL.finditer(text)]
    if re.search(r"\d[\d.() -]{6}", text):
        for m in CARD.finditer(text):
            found.append(Entity("account" if luhn(re.sub(r"\D", "", m[0])) else "card", *m.span(), ""))
        for kind, pattern in (("ssn", SSN), ("phone", PHONE), ("ip", IP)):
            found += [Entity(kind, *m.span(), "") for m in pattern.finditer(text)]
    found += names(text)
    if not found:
        return []
    taken = bytearray(len(text))

    def free(entities: list[Entity]) -> list[Entity]:
        out = []
        for e in entities:
            if not any(taken[e.start : e.end]):
                taken[e.start : e.end] = b"1" * (e.end - e.start)
                out.append(e)
        return out

    out = free(sorted(found, key=lambda e: (KINDS.index(e.kind), e.start)))
    out = one_gender(text, out)
    return sorted(out + free(repeats(text, out)), key=lambda e: e.start)


def one_gender(text: str, found: list[Entity]) -> list[Entity]:
    """Given names of unknown gender have that of the first mention with one."""
    known: dict[str, str] = {}
    for e in sorted(found, key=lambda e: e.start):
        if e.kind == "given" and not e.group.endswith(".u"):
            known.setdefault(text[e.start : e.end].casefold(), e.group)
    return [e._replace(group=known.get(text[e.start : e.end].casefold(), e.group)) if e.group.endswith(".u") else e for e in found]


def repeats(text: str, found: list[Entity]) -> list[Entity]:
    """Capitalised words that equal a found name but for case; a word found as several names counts as the first."""
    names: dict[str, Entity] = {}
    for e in sorted((e for e in found if e.group), key=lambda e: e.start):
        names.setdefault(text[e.start : e.end].casefold(), e)
    if not names:
        return []
    words = ((m, names.get(m[0].casefold())) for m in re.finditer(rf"(?<!\w){WORD.pattern}(?!\w)", text) if m[0][0].isupper())
    return [Entity(e.kind, *m.span(), e.group) for m, e in words if e]


class Permutation:
    """Keyed one-to-one map of the numbers below n without fixed points (but for n = 1).

    Six Feistel rounds on two near-equal factors, walked on until below n, give each number a place in a secret order; a
    number goes to the one at the next place, so all numbers are one cycle.
    """

    def __init__(self, key: bytes, tweak: str, n: int) -> None:
        self.key, self.tweak, self.n = key, tweak.encode(), n
        self.a = int(n**0.5) if n < 1 << 52 else 1 << (n.bit_length() + 1) // 2
        while self.a * self.a < n:
            self.a += 1

    def _round(self, i: int, x: int) -> int:
        return int.from_bytes(hmac.digest(self.key, b"%d:%d:" % (i, x) + self.tweak, "sha256")[:16], "big")

    def place(self, x: int) -> int:
        while True:
            left, right = divmod(x, self.a)
            for i in range(6):
                left, right = right, (left + self._round(i, right)) % self.a
            x = left * self.a + right
            if x < self.n:
                return x

    def at(self, x: int) -> int:
        """The number at a place."""
        while True:
            left, right = divmod(x, self.a)
            for i in reversed(range(6)):
                left, right = (right - self._round(i, left)) % self.a, left
            x = left * self.a + right
            if x < self.n:
                return x

    def __call__(self, x: int, valid: Callable[[int], bool] = lambda _: True) -> int:
        """The next valid number of the cycle after x; one to one among valid numbers."""
        place = self.place(x)
        while True:
            place = (place + 1) % self.n
            if valid(y := self.at(place)):
                return y


def reshape(key: bytes, kind: str, value: str) -> str:
    """Keyed permutation of the strings of the same format: ASCII letters by case and digits vary, the rest stays."""
    radix = [10 if c.isdigit() and c.isascii() else 26 if c.isascii() and c.isalpha() else 1 for c in value]
    shape = "".join("9" if r == 10 else ("a" if c.islower() else "A") if r == 26 else c for r, c in zip(radix, value))
    n, x = 1, 0
    for r, c in zip(radix, value):
        if r > 1:
            n, x = n * r, x * r + (int(c) if r == 10 else ord(c.lower()) - 97)
    if n == 1:
        return value
    x = Permutation(key, f"{kind}:{shape}", n)(x)
    out = []
    for r, c in zip(reversed(radix), reversed(value)):
        if r > 1:
            x, d = divmod(x, r)
            c = str(d) if r == 10 else chr((97 if c.islower() else 65) + d)
        out.append(c)
    return "".join(reversed(out))


#: Address blocks that stay among themselves: private, loopback, "this network", multicast and reserved.
BLOCKS = (("10.0.0.0", 8), ("172.16.0.0", 12), ("192.168.0.0", 16), ("127.0.0.0", 8), ("0.0.0.0", 8), ("224.0.0.0", 3))


def ip_number(value: str) -> int:
    return int.from_bytes(bytes(map(int, value.split("."))), "big")


def ip_block(x: int) -> tuple[int, int] | None:
    """(first address, size) of the special block of an address."""
    for first, bits in BLOCKS:
        size = 1 << 32 - bits
        if x // size == ip_number(first) // size:
            return ip_number(first), size
    return None


def permute_ip(key: bytes, value: str) -> str:
    """Octets keep their value range, not their width; special addresses stay in their block."""
    x = ip_number(value)
    if block := ip_block(x):
        x = block[0] + Permutation(key, f"ip{block[0]}", block[1])(x - block[0])
    else:
        x = Permutation(key, "ip", 1 << 32)(x, lambda y: ip_block(y) is None)
    return ".".join(map(str, x.to_bytes(4, "big")))


def permute_card(key: bytes, value: str) -> str:
    """The issuer digit, the checksum's remainder and the spacing stay."""
    digits = re.sub(r"\D", "", value)
    rest = luhn(digits)
    body = int(digits[1:-1])
    body = Permutation(key, f"card:{digits[0]}:{rest}:{len(digits)}", 10 ** (len(digits) - 2))(body)
    head = digits[0] + str(body).zfill(len(digits) - 2)
    new = iter(head + next(d for d in "0123456789" if luhn(head + d) == rest))
    return re.sub(r"\d", lambda _: next(new), value)


def pick_name(key: bytes, value: str, group: str, attempt: int) -> str:
    """Attempt 0: a name of the pool by keyed hash. Attempt k: the k-th hyphenated name; different k, different names.

    Pools of m and f share no name, and names for unknown gender (u) end in one of the other pool, so no two groups meet.
    """
    name, part = group.split(".")
    pool = POOLS[name, "m" if part == "u" else part]
    if attempt == 0:
        both = pool + POOLS[name, "f"] if part == "u" else pool
        out = both[int.from_bytes(hmac.digest(key, f"{group}:{value.casefold()}".encode(), "sha256")[:8], "big") % len(both)]
    else:
        at, parts = attempt - 1 + len(pool), []
        while at:
            at, d = divmod(at, len(pool))
            parts.append(pool[d])
        out = "-".join(parts + [POOLS[name, "f"][0]] * (part == "u"))
    return out.upper() if value.isupper() and len(value) > 1 else out


def surrogate(key: bytes, kind: str, value: str, group: str = "", attempt: int = 0) -> str:
    """The replacement of an entity; only names use ``attempt``, which picks the next candidate."""
    if kind == "email":
        local, domain = value.rsplit("@", 1)
        host, top = domain.rsplit(".", 1)
        return f"{reshape(key, 'local', local)}@{'.'.join(reshape(key, 'host', h) for h in host.split('.'))}.{top}"
    if kind in ("card", "account"):
        return permute_card(key, value)
    if kind == "ip":
        return permute_ip(key, value)
    if kind == "phone" and value.startswith("+"):
        code = re.match(r"\+\d{1,3}(?=\D)|\+\d", value)[0]
        return code + reshape(key, f"phone{code}", value[len(code) :])
    if kind == "phone" and (trunk := re.match(r"[01](?=[ .(-])", value)):
        return trunk[0] + reshape(key, f"phone trunk {trunk[0]}", value[1:])
    if group:
        return pick_name(key, value, group, attempt)
    return reshape(key, kind, value)


def _entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in rows_of(batch):
            names = {(e.group, t[e.start : e.end].casefold()) for t in part.column(0).to_pylist() for e in find(t) if e.group}
            groups, values = zip(*sorted(names)) if names else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(groups, pa.string()), pa.array(values, pa.string())], ["group", "value"])


def _choices(key: bytes):
    """(group, value, attempt, choice): the names that the attempts give."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, v, n = (batch.column(i).to_pylist() for i in range(3))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([pick_name(key, b, a, c).casefold() for a, b, c in zip(g, v, n)], pa.string())], ["group", "value", "attempt", "choice"])

    return run


def settle(names: DataFrame, key: bytes) -> DataFrame:
    """(group, value, as_group, attempt): what gives each name a replacement that no other has and that is no original; exceptions only.

    Given names of unknown gender are taken for those of the one gender that they have elsewhere. Of the names that share a
    first choice the first keeps it; the others, and names whose first choice is an original of their script and part, get numbers
    that differ within a script and part, from buckets by hash and ranks within them; numbers that give an original are counted on.
    """
    script_of = F.regexp_extract("group", r"^(\w+)\.", 1)
    part = F.when(F.col("group").endswith("family"), F.lit("family")).otherwise(F.lit("given"))
    own = names.select("group", "value", F.concat_ws(".", script_of, part).alias("pool"))
    known = own.where(part == "given").groupBy("pool", "value").agg(F.array_compact(F.collect_set(F.when(~F.col("group").endswith(".u"), F.col("group")))).alias("known"))
    own = own.join(known, ["pool", "value"], "left")
    alias = F.col("group").endswith(".u") & (F.size("known") == 1)
    own = durable(own.select("group", "value", "pool", F.when(alias, F.get("known", F.lit(0))).otherwise(F.col("group")).alias("as_group")))
    who = own.select(F.col("as_group").alias("group"), "value", F.lit(0).cast("long").alias("attempt")).distinct()
    named = who.mapInArrow(_choices(key), "group string, value string, attempt long, choice string")
    chosen = durable(named.withColumn("pool", F.concat_ws(".", script_of, part)))
    originals = own.select("pool", F.col("value").alias("choice")).distinct()
    # The first name by value keeps its choice; no window over a pool is needed until someone has to move.
    owner = chosen.join(originals, ["pool", "choice"], "left_anti").groupBy("pool", "choice").agg(F.min(F.struct("value", "group")).alias("owner"))
    moved = chosen.join(owner, ["pool", "choice"], "left").where(F.col("owner").isNull() | (F.col("owner.value") != F.col("value")) | (F.col("owner.group") != F.col("group")))
    moved = moved.withColumn("bucket", F.pmod(F.xxhash64("value", "group"), F.lit(BUCKETS)))
    rank = F.row_number().over(Window.partitionBy("pool", "bucket").orderBy("value", "group"))
    moved = durable(moved.select("group", "value", ((rank - 1) * F.lit(BUCKETS) + F.col("bucket") + 1).cast("long").alias("attempt")))
    while True:
        named = moved.mapInArrow(_choices(key), "group string, value string, attempt long, choice string").withColumn("pool", F.concat_ws(".", script_of, part))
        hits = durable(named.join(originals, ["pool", "choice"], "left_semi").select("group", "value"))
        if hits.isEmpty():
            break
        step = moved.agg(F.max("attempt")).first()[0]
        moved = moved.join(hits.withColumn("hit", F.lit(True)), ["group", "value"], "left")
        moved = durable(moved.select("group", "value", F.when(F.col("hit"), F.col("attempt") + step).otherwise(F.col("attempt")).alias("attempt")))
    out = own.join(moved.withColumnRenamed("group", "as_group"), ["as_group", "value"], "left").withColumn("attempt", F.coalesce("attempt", F.lit(0).cast("long")))
    return out.where("attempt > 0 OR group != as_group").select("group", "value", "as_group", "attempt")


#: Buckets over which the names that have to move are numbered.
BUCKETS = 512


def replace(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_<kind> for each kind, text) for every row: the text with its entities replaced.

    Null texts stay null, with counts of 0; texts without entities are unchanged; repeated rows are alike; an empty table gives
    an empty result; other columns are ignored, whatever their names. Equal originals (names: but for case) have equal replacements in all documents, different ones different
    replacements of the same type. The exceptions that the name check finds are broadcast if they are at most BROADCAST_ROWS;
    beyond that each document gets its own by a join.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text"))
    # Used several times below, and found by reading all texts.
    names = durable(rows.select("_text").mapInArrow(_entities, "group string, value string").distinct())
    moved = durable(settle(names, key))
    out = f"_id {kind}, " + ", ".join(f"n_{k} int" for k in KINDS) + ", _text string"
    if moved.count() <= BROADCAST_ROWS:
        shared = docs.sparkSession.sparkContext.broadcast({(r.group, r.value): (r.as_group, r.attempt) for r in moved.collect()})
        done = rows.mapInArrow(_replacer(key, lambda: shared.value), out)
    else:
        # Each name of a document finds its attempt; a document's few exceptions travel with its text.
        uid = rows.withColumn("uid", F.xxhash64("_id", "_text"))
        own = uid.mapInArrow(_own_names, "uid long, group string, value string").distinct().join(moved, ["group", "value"])
        own = own.groupBy("uid").agg(F.collect_list(F.struct("group", "value", "as_group", "attempt")).alias("moved"))
        done = uid.join(own, "uid", "left").select("_id", "_text", "moved").mapInArrow(_replacer(key, None), out)
    return done.withColumnsRenamed({"_id": id_col, "_text": text_col})


def _own_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in rows_of(batch):
            text, uid = part.column("_text").to_pylist(), part.column("uid").to_pylist()
            found = [(u, e.group, t[e.start : e.end].casefold()) for u, t in zip(uid, text) for e in find(t) if e.group]
            a, b, c = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.string()), pa.array(c, pa.string())], ["uid", "group", "value"])


def _replacer(key: bytes, shared: Callable[[], dict] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, str] = {}
        moved = shared() if shared else {}
        for batch in batches:
            for part in rows_of(batch):
                texts, counts = [], {k: [] for k in KINDS}
                own = part.column("moved").to_pylist() if not shared else [None] * part.num_rows
                for text, mine in zip(part.column("_text").to_pylist(), own):
                    attempts = {(m["group"], m["value"]): (m["as_group"], m["attempt"]) for m in mine} if mine else moved
                    found = find(text)
                    out, at = [], 0
                    for e in found:
                        value = text[e.start : e.end]
                        group, attempt = attempts.get((e.group, value.casefold()), (e.group, 0))
                        new = known.get((e.kind, value, group, attempt))
                        if new is None:
                            if len(known) > 100_000:
                                known.clear()
                            new = known[e.kind, value, group, attempt] = surrogate(key, e.kind, value, group, attempt)
                        out += [text[at : e.start], new]
                        at = e.end
                    texts.append(text if text is None else "".join(out) + text[at:])
                    for k in KINDS:
                        counts[k].append(sum(e.kind == k for e in found))
                yield pa.RecordBatch.from_arrays([part.column("_id"), *(pa.array(counts[k], pa.int32()) for k in KINDS), pa.array(texts, pa.string())], ["_id", *(f"n_{k}" for k in KINDS), "_text"])

    return run


def key_from(secret: str) -> bytes:
    return hashlib.sha256(secret.encode()).digest()
