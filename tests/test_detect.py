import re
import time
import unicodedata

import pytest
from hypothesis import HealthCheck, Phase, given, settings, strategies as st
from pyspark.sql import functions as F

import plain
from conftest import SF_SMALL
from veilframe.functions import checks, fixed_values as fv, regex, text as tx
from veilframe.functions.types import parse_types
from veilframe.operators import detect as d
from veilframe.plans import forms
from veilframe.plans.tables import spread

CASES = [
    ("Risposta a ufficio.ordini+b2b@ditta-nord.example entro sera", "EMAIL"),
    ("Bonifico su IBAN: GB82WEST12345698765432", "IBAN"),
    ("CF: %s", "CF"),
    ("P.IVA: 12345678903", "PIVA"),
    ("Carta: 5555555555554444", "CARD"),
    ("Carta 4242 4242 4242 4242", "CARD"),
    ("Importo: €7.480,50 alla consegna", "AMOUNT"),
    ("Stipendio: 1.875,25 lordo", "AMOUNT"),
    ("reddito: 48200", "AMOUNT"),
    ("28 ottobre 2019", "DATE"), ("7 set 1988", "DATE"), ("9 nov. 2021", "DATE"),
    ("1° maggio 2018", "DATE"), ("luglio 2017", "DATE"), ("24/12/1976", "DATE"),
    ("+39 347 8901234", "PHONE"), ("+447911123456", "PHONE"),
    ("Abita in Via Garibaldi, 42 – Torino", "ADDR"), ("Piazza Dante 3, Napoli", "ADDR"),
    ("firmato dal Dott. Piero Galli", "PERSON"), ("con la Sig.ra Elena Fontana", "PERSON"),
    ("Prof.ssa Giulia Serra", "PERSON"), ("Cliente: Nadia Colombo", "PERSON"),
    ("c/c: 000045000098765432101234", "ACCOUNT"), ("Account number: QX90817263", "ACCOUNT"),
    ("Passaporto: BC7654321", "PASSPORT"), ("DNI 87654321X", "ID_CARD"),
    ("Patente di guida: TO7654321K", "DRIVING_LICENSE"), ("Targa GH456JK", "PLATE"),
    ("BIC DEUTDEFFXXX", "BIC"), ("CVV: 907", "CVV"), ("Scadenza 09/29", "CARD_EXPIRY"),
    ("Nodo 172.16.254.3 spento", "IP"),
    ("Rete fe80:0000:0000:0000:0204:61ff:fe9d:f156 su", "IP"),
    ("Scheda 5E:FF:56:A2:AF:15", "MAC"), ("Leggi https://docs.example.org/guida ora", "URL"),
    ("Usuario: lucia88", "USERNAME"), ("Matricola: 0076543", "EMPLOYEE_ID"),
    ("Cartella MED-907856 aperta", "MEDICAL_ID"), ("Numero polizza 554433", "INSURANCE_ID"),
    ("SSN: 987-65-4321", "TAX_ID"),
    ("Calle Luna 8, Toledo", "ADDR"), ("Correo: ines.gil@example.org", "EMAIL"),
    ("Número de póliza: 443322", "INSURANCE_ID"), ("Rue du Moulin 17", "ADDR"),
    ("Téléphone: +33 7 98 76 54 32", "PHONE"), ("Numéro fiscal: FR98765432109", "TAX_ID"),
    ("Morada: Rua Direita 21, Braga", "ADDR"), ("Telefone: +351 934 567 890", "PHONE"),
    ("Adresse: Lindenstraße 9, Bremen", "ADDR"), ("Telefon: +49 40 98765432", "PHONE"),
    ("Steuernummer: DE987654321", "TAX_ID"), ("Personalausweis: K33000456", "ID_CARD"),
]
FISCAL = next(c for c in ("BNCLRA92D45F839" + x for x in "ABCDEFGHIJKLMNOPQRSTUVWXYZ") if plain.fiscal_code(c))
CASES = [(text.replace("%s", FISCAL), type_) for text, type_ in CASES]
NOTHING = [
    ("IBAN: GB83WEST12345698765432", "IBAN"), ("CF: " + FISCAL[:-1] + chr(65 + (ord(FISCAL[-1]) - 64) % 26), "CF"),
    ("P.IVA: 12345678904", "PIVA"), ("Carta: 5555555555554445", "CARD"),
    ("Pratica 987654321098 chiusa", "ACCOUNT"),
]
NEUTRAL = (
    "Domani piove quasi ovunque. Le train part tôt ce matin. El perro duerme al sol. "
    "Der Kuchen ist schon fertig. A janela ficou aberta. The kettle is warm again."
)
ODD = [
    "x﷐ a@b.it ﷑ c@d.it", "😀 a@b.it 😀😀 Passaporto: YA1234567", "STİPENDIO: 300 ſALDO 12",
    "prezzo²5 n² 5", "5€a 5€ a", "a\u00a0giugno\u202f2024", "mario.rossi@a.b.co.uk,x@y.zz.",
    "Mr John Smith\nMrs Ann Lee", "USER: a.b- x", "DNI 12345678- X", "é15/01/1980 15/01/1980é",
    "1." * 3000 + "1", "::1 fe80::1 a:b:c:d:e:f:1:2", "Nome: Anna D'Angelo De Luca", "", "   ",
]


def spark_spans(spark, texts, **options):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(8)
    found = d.with_rule_spans(rows, **options).collect()
    return {r.doc_id: [tuple(s) for s in r.spans] for r in found}


def same_as_plain(spark, texts, **options):
    got = spark_spans(spark, texts, **options)
    for i, text in enumerate(texts):
        assert got[i] == plain.spans(text, **options), repr(text[:300])


def test_listed_cases(spark):
    texts = [t for t, _ in CASES + NOTHING] + [NEUTRAL]
    got = spark_spans(spark, texts)
    for i, (text, type_) in enumerate(CASES):
        assert type_ in {s[3] for s in got[i]}, text
    for i, (text, type_) in enumerate(NOTHING, len(CASES)):
        assert type_ not in {s[3] for s in got[i]}, text
    assert got[len(texts) - 1] == []
    same_as_plain(spark, texts)


def test_odd_texts_at_all_thresholds(spark):
    same_as_plain(spark, ODD + [t.swapcase() for t, _ in CASES])
    same_as_plain(spark, ODD, threshold=0.0)
    same_as_plain(spark, ODD, threshold=0.9, types=["EMAIL", "DATE"])


LONG = {
    "1." * 50000: 12500, "€1" + ".000" * 25000: 1, "1" + ".000" * 25000 + " euro": 8333, "a" * 100000: 0,
    "nome " * 20000: 0, "Via Roma" + " " * 20000: 0, "importo" + " " * 90000: 0, "x@" + "a." * 45000: 0,
    "a.b@c.it " * 11000: 11000, "Nome Mario Rossi " * 5800: None,
}


def test_long_hostile_texts_finish_fast(spark):
    """None of these may take time that grows with the square of the length."""
    rows = spark.createDataFrame([(i, t[:100000]) for i, t in enumerate(LONG)], "i int, text string").repartition(8)
    d.detect(rows.limit(1)).collect()
    start = time.perf_counter()
    got = {r.i: r.n for r in d.detect(rows).select("i", F.size("entities").alias("n")).collect()}
    assert time.perf_counter() - start < 60
    for i, n in enumerate(LONG.values()):
        assert n is None or got[i] == n


def test_threshold_range():
    with pytest.raises(ValueError):
        d.rules(1.5, None)


def test_whole_testdata(spark):
    texts = [
        r.text for name in ("documents", "conversations")
        for r in spark.read.parquet(f"{SF_SMALL}/{name}.parquet").select("text").collect()
    ] + [r.html for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").select("html").collect()]
    same_as_plain(spark, texts)


def generated_texts():
    """Matches of every pattern, made up by hypothesis, in varying surroundings."""
    texts = []

    def collect(strategy, count):
        @settings(max_examples=count, database=None, deadline=None, derandomize=True,
                  phases=[Phase.generate], suppress_health_check=list(HealthCheck))
        @given(strategy)
        def run(value):
            texts.append(value)

        run()

    around = st.sampled_from(["", " ", "x", "9", "é", "\n", ", ", ".", "_", "²", "\u00a0", "ſ"])
    for _, _, pattern in plain.COMPILED:
        collect(st.tuples(around, st.from_regex(pattern, fullmatch=True), around).map("".join), 40)
    return [t for t in texts if "\x00" not in t and t.isprintable() or "\n" in t]


def test_generated_matches(spark):
    texts = [t for t in generated_texts() if not any(0xD800 <= ord(c) < 0xE000 for c in t)]
    assert len(texts) > 1000
    same_as_plain(spark, texts, threshold=0.0)
    same_as_plain(spark, [" ".join(texts[i::40]) for i in range(40)], threshold=0.0)


def test_quick_tests_hold_for_generated_matches():
    for i, (type_, _, pattern) in enumerate(plain.COMPILED):
        stems = regex.label_stems(fv.PATTERNS[i][2])
        seen = []

        @settings(max_examples=60, database=None, deadline=None, derandomize=True,
                  phases=[Phase.generate], suppress_health_check=list(HealthCheck))
        @given(st.from_regex(pattern, fullmatch=True))
        def run(value):
            digits = max((len(x) for x in re.findall("[0-9]+", value)), default=0)
            seen.append(value)
            assert digits >= d.DIGITS_NEEDED.get(type_, d.DIGITS_NEEDED.get(i, 0))
            assert re.search(d.SEARCH_NEEDED.get(i, "").replace("\\p{L}", "\\w"), value)
            low = value.translate(str.maketrans(d.ODD_LETTERS, d.THEIR_TWINS)).lower()
            assert any(piece in low for piece in d.TEXT_NEEDED.get(i, [""]))
            assert not stems or any(s in low for s in stems)

        run()
        assert seen


def test_values_are_where_the_offsets_say(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    spans = d.explode_spans(d.detect(docs), "doc_id", "text")
    wrong = spans.where(F.expr("substring(text, start + 1, end - start) <> value"))
    assert spans.count() > 0 and wrong.count() == 0


def test_checksums(spark):
    values = ["4532015112830366", "4532 0151-12830366", "1234567890128", "0000", "", "02182080396",
              "IT60X0542811101000000123456", "it60 x054 2811 1010 0000 0123 456", "GB82WEST12345698765432",
              "RSSMRA80A01H501U", "rssmra80a01h501u", "RSSMRA80A01H501Z", "A" * 16, "ab-c"]
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    for name, check in checks.CHECKS.items():
        got = [r[0] for r in rows.select(check(F.col("v"))).collect()]
        assert got == [plain.passes(name, v) for v in values], name


def test_type_filter():
    assert parse_types(None) is None and parse_types("") is None and parse_types(" , ") is None
    assert parse_types("addr,ADDRESS, org ,LOCATION") == ["ADDR", "ORG", "LOC"]
    with pytest.raises(ValueError, match="Tipo entità sconosciuto: 'NOPE'"):
        parse_types(["EMAIL", "nope"])


def test_nfc_test_covers_every_character():
    import regex as full_regex
    pattern = full_regex.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: "\\U" + m[1].zfill(8), tx.MAY_CHANGE))
    second = set()
    for code in range(0x110000):
        parts = unicodedata.decomposition(chr(code))
        if parts and not parts.startswith("<"):
            second.add(int(parts.split()[-1], 16)) if " " in parts else None
    for code in range(0x110000):
        c = chr(code)
        if 0xD800 <= code < 0xE000 or (code in second and code < 0x300):
            continue
        if unicodedata.normalize("NFC", c) != c or unicodedata.combining(c) or code in second:
            assert pattern.search(c), hex(code)


def test_nfc(spark):
    texts = ["plain", "cafe\u0301", "naïve", "\u212b", "\u1100\u1161", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.x for r in rows.select("i", tx.nfc(F.col("t")).alias("x")).collect()}
    assert [got[i] for i in range(len(texts))] == [
        None if t is None else unicodedata.normalize("NFC", t) for t in texts
    ]


def widest(pattern):
    """The width of the widest match if no character is repeated without limit more than RUN times."""
    from re import _constants as c, _parser

    def width(items):
        total = 0
        for op, given in items:
            if op in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT):
                _, most, body = given
                total += d.RUN if most is c.MAXREPEAT else most * width(body)
            elif op is c.SUBPATTERN:
                total += width(given[-1])
            elif op is c.BRANCH:
                total += max(map(width, given[1]))
            elif op not in (c.AT, c.ASSERT, c.ASSERT_NOT):
                total += 1
        return total

    return width(_parser.parse(pattern, re.IGNORECASE))


def test_matches_at_labels_fit_their_windows():
    labelled = [p for _, _, p in fv.PATTERNS if d._has_label(p)]
    assert len(labelled) >= 20
    for pattern in labelled:
        assert widest(pattern) < d.WINDOW - 1, pattern
        head, _, rest = pattern.partition("(?P<v>")
        assert not head.startswith((r"\b", "(?<"))
        unlimited = set(re.findall(r"(\[[^\]]*\]|\\s|\)|\w)[*+]", pattern))
        assert unlimited <= {r"\s", r"[\s:]", r"[\s.:#]", r"[\s.:#nº°]", "[ \t]", r"[ \t]", "[a-zà-öø-ÿß'’]", ")"}, unlimited


def test_label_starts_cover_generated_labels():
    """Whatever a label pattern matches, the scan of the lower-case text marks its first character, with letters
    that lead to the pattern."""
    java = {r"\\p{L}": r"[^\W\d_]"}
    labelled = [(i, p) for i, (_, _, p) in enumerate(fv.PATTERNS) if d._has_label(p)]
    starts = regex.label_starts(tuple(p for _, p in labelled)).replace("(?-iu:", "(?:").replace("(?s:..)", "(?s:..)")
    assert java and re.compile(starts)
    for i, pattern in labelled:
        two, one = regex.first_letters(pattern)

        @settings(max_examples=60, database=None, deadline=None, derandomize=True, phases=[Phase.generate], suppress_health_check=list(HealthCheck))
        @given(st.from_regex(plain.COMPILED[i][2], fullmatch=True))
        def run(value):
            low = value.translate(str.maketrans(d.ODD_LETTERS, d.THEIR_TWINS)).lower()
            found = re.compile(starts).match(low)
            assert found and (found[1] in two or found[1][0] in one), value

        run()


def test_windows_and_runs_at_their_limits(spark):
    """Labels at the ends of blocks, matches over them, runs of characters just under and over the limit."""
    texts = []
    for n in [*range(d.BLOCK - 40, d.BLOCK + 3, 7), 2 * d.BLOCK - 5, 3 * d.BLOCK]:
        texts += ["x" * 30 + " y" * ((n - 30) // 2) + " Cliente: Mario Rossi Passaporto: YA1234567 😀" * 3]
    for n in (d.RUN - 1, d.RUN, d.RUN + 1, 700):
        texts += [f"importo{' ' * n}12,50 saldo: 3", f"nome Mario R{'o' * n}ssi utente anna", f"totale 1{'.000' * n}"]
    texts += ["nome Cliente Mario Rossi Bianchi " * 40, "saldo saldo saldo 12 importo:12 n. conto 123456789012 login account: rossi.1"]
    same_as_plain(spark, texts)
    same_as_plain(spark, texts, threshold=0.9)


def test_narrow_rows_are_dealt_out_by_their_number(spark, monkeypatch):
    """Texts made of narrow rows go to as many tasks as they need, however few files hold the rows."""
    monkeypatch.setattr(forms, "FORMS_EACH", 5)
    n = spark.read.parquet(f"{SF_SMALL}/customer.parquet").count()
    for fields in (forms.FIELDS, forms.GATE_FIELDS):
        made = forms.forms(spark, SF_SMALL, fields)
        assert made.rdd.getNumPartitions() == -(-n // 5) > spark.sparkContext.defaultParallelism
        assert made.count() == n
    assert spread(spark.range(1000), 10).rdd.getNumPartitions() == 100


def test_scans_keep_finds_and_not_copies_of_the_text(spark):
    """A pattern with a few finds leaves these alone behind, one with many a marked copy; both give the same spans."""
    texts = [f"é {d.MARK} " + "a@b.it, " * n + "😀 x@y.zz" for n in (0, 1, d.FEW - 1, d.FEW, 3 * d.FEW)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    for text, row in zip(texts, rows.select(d._hits("text", d.rules(0.7, ["EMAIL"])).alias("h")).collect()):
        (hit,), n = row.h.hits, text.count("@")
        assert (hit.marked is None, len(hit.finds)) == ((True, n) if n <= d.FEW else (False, 0))
    same_as_plain(spark, texts)
    same_as_plain(spark, ["x" * 64 + "@a.it", "x" * 65 + "@a.it", "a.b-@c.it é@c.it K@c.it", "+0039 333 1234567 ++39 333 1234567", "a1111-2222-3333-4444"])


def test_few_patterns_are_tried_at_a_label(spark):
    """Up to five letters of a label lead to its patterns, a window is cut once for all of them, and each generated
    match begins with letters that lead to its pattern."""
    labelled = [(i, p) for i, (_, _, p) in enumerate(fv.PATTERNS) if d._has_label(p)]

    def leads(low, pattern):
        return any(low[:width] in heads for width, heads in regex.beginnings(pattern).items())

    starts = re.compile(regex.label_starts(tuple(p for _, p in labelled)).replace("(?-iu:", "(?:"))
    for i, pattern in labelled:
        @settings(max_examples=40, database=None, deadline=None, derandomize=True, phases=[Phase.generate], suppress_health_check=list(HealthCheck))
        @given(st.from_regex(plain.COMPILED[i][2], fullmatch=True))
        def run(value):
            low = value.translate(str.maketrans(d.ODD_LETTERS, d.THEIR_TWINS)).lower()
            found = starts.match(low)
            assert found and found[1] + found[2] == low[:regex.LETTERS] and leads(low, pattern), value

        run()
    for label, most in {"personalausweis": 3, "passaporto": 2, "kontonummer": 1, "cartella clinica": 3, "betrag": 1}.items():
        assert 1 <= sum(leads(label, p) for _, p in labelled) <= most, label
    rows = spark.createDataFrame([("Passaporto: YA1234567",)], "text string")
    plan = d.with_rule_spans(rows)._jdf.queryExecution().analyzed().toString()
    assert plan.count(f"% {d.BLOCK}) + 1), {d.WINDOW})") == 1
    texts = ["nome: Anna Neri, nome: Anna Bianchi utente Anna Verdi; utente: anna.b", "SSN: 123-45-6789 nir: 1 85 05 78 123 123 nuss: 28 1234567 n. conto 123456789012"]
    same_as_plain(spark, texts + ["passaport", "ss", "n", "saldo 1 saldo 2 targa: AB 123 CD tarGA: EF 456 GH saldo", "Ç importo 5 😀 pass YA1234567"])
