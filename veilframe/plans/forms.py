"""Labelled texts made of the rows of customers and their orders, with all 27 types.

One text per customer: a field for each pattern (and some that must not be found), then two fields for every
order.  A field is plain text and a value, both given as an expression that Spark and DuckDB read alike, over
k (the customer's key), d (the key with seven digits) and the columns of orders.  The SQL knows the finds by
construction: it adds up the lengths of the pieces and searches nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import fixed_values as fv
from .tables import parts, spread, table

_IBAN_REST = (3305428 * 10**23 + 182900) % 97
_ODD = "'" + " ".join(f"{n:02d}" for n in fv.FISCAL_ODD_DIGITS) + "'"


def _odd(digit: str) -> str:
    return f"CAST(substr({_ODD}, CAST(3 * ({digit}) + 1 AS INT), 2) AS INT)"


def _at(digits: str, place: int) -> str:
    return f"CAST(substr({digits}, {place}, 1) AS INT)"


def _text(number: str, width: int) -> str:
    return f"lpad(CAST({number} AS STRING), {width}, '0')"


def _odd_letter(letter: str) -> int:
    return fv.FISCAL_ODD_LETTERS[ord(letter) - 65]


_YEAR, _PLACE = _text("k % 100", 2), _text("k % 1000", 3)
# RSSMRA yy A 01 H ppp: letters and digits at odd places by table, the others by value.
_CF_SUM = " + ".join([
    str(sum(_odd_letter(c) for c in "RSR") + sum(ord(c) - 65 for c in "SMA") + _odd_letter("A") + fv.FISCAL_ODD_DIGITS[1] + ord("H") - 65),
    _odd(_at(_YEAR, 1)), _at(_YEAR, 2), _odd(_at(_PLACE, 1)), _at(_PLACE, 2), _odd(_at(_PLACE, 3)),
])
_NUMBER = "CAST(k % 900 + 1 AS STRING)"
_DAY = _text("k % 28 + 1", 2)
_FOUR, _THREE, _TWO = "right(d, 4)", "right(d, 3)", "right(d, 2)"

#: (plain text before, value, type or None if it must not be found, confidence); a type "CARD?" or "PIVA?" counts
#: if the digits pass the sum of Luhn, which the SQL does itself; "IBAN?" and "CF?" where the key is even.
FIELDS = [
    ("Mail: ", "'Ann.K' || k || '@Example.com'", "EMAIL", 0.99),
    (" ; senza dominio: ", "'Ann.K' || k || '@example'", None, 0),
    (" ; IBAN: ", f"'IT' || {_text(f'98 - ({_IBAN_REST} + (k % 97) * {10**6 % 97}) % 97 + k % 2', 2)} || 'X05428' || {_text('k', 17)}", "IBAN?", 0.99),
    (" ; CF: ", f"'RSSMRA' || {_YEAR} || 'A01H' || {_PLACE} || chr(CAST(65 + ({_CF_SUM} + k % 2) % 26 AS INT))", "CF?", 0.99),
    (" ; P. IVA: ", f"'1' || {_text('k * 7', 10)}", "PIVA?", 0.99),
    (" ; Tel. ", "'+39 333 ' || d", "PHONE", 0.92),
    (" ; Fisso: ", f"'0612 3' || {_TWO} || ' ' || {_FOUR}", "PHONE", 0.85),
    (" ; Estero: ", "'+39123' || d", "PHONE", 0.80),
    (" ; Londra: ", f"'+44 20 7' || {_THREE} || ' 1' || {_THREE}", "PHONE", 0.82),
    (" ; corto: ", f"'+44 ' || {_TWO}", None, 0),
    (" ; CAP ", f"'1' || {_FOUR}", None, 0),
    (" ; nato il ", f"{_DAY} || '/11/1971'", "DATE", 0.95),
    (" ; firmato ", f"'2021-11-' || {_DAY}", "DATE", 0.95),
    (" ; visto ", f"{_DAY} || ' novembre 2021'", "DATE", 0.90),
    (" ; rinnovo ", "'marzo ' || CAST(2000 + k % 90 AS STRING)", "DATE", 0.80),
    (" ; mese ", f"{_DAY} || '/13/2021'", None, 0),
    (" ; Paga ", f"'€ 1.' || {_THREE} || ',50'", "AMOUNT", 0.95),
    (" ; oppure ", f"'12.' || {_THREE} || ' euro'", "AMOUNT", 0.95),
    (" ; Saldo: ", f"'4' || {_TWO} || ',10'", "AMOUNT", 0.82),
    (" ; Carta ", f"'4' || {_text('k * 7919', 15)}", "CARD?", 0.95),
    (" ; Carta ", f"'5500 1' || {_THREE} || ' 2' || {_THREE} || ' 4' || {_THREE}", "CARD?", 0.90),
    (" ; Carta ", f"'4782 1' || right(d, 5) || ' 1' || {_FOUR}", "CARD?", 0.90),
    (" ; BIC: ", f"'DEUTDEFF' || {_THREE}", "BIC", 0.92),
    (" ; banca ", f"'UNCRIT' || chr(CAST(65 + k % 26 AS INT)) || 'M'", "BIC", 0.72),
    (" ; CVV: ", _THREE, "CVV", 0.88),
    (" ; valid thru: ", f"{_text('k % 12 + 1', 2)} || '/29'", "CARD_EXPIRY", 0.85),
    (" ; valid thru: ", f"'13/' || {_TWO}", None, 0),
    (" ; c/c: ", f"'2' || {_text('k', 11)}", "ACCOUNT", 0.95),
    (" ; Kontonummer: ", "'KT' || d", "ACCOUNT", 0.90),
    (" ; Sede: ", f"'Via Garibaldi, ' || {_NUMBER}", "ADDR", 0.78),
    (" ; Filial: ", f"'Calle Mayor, ' || {_NUMBER}", "ADDR", 0.76),
    (" ; Ort: ", f"'Lindenstraße ' || {_NUMBER}", "ADDR", 0.76),
    (" ; Place: ", f"{_NUMBER} || ' Baker Street'", "ADDR", 0.76),
    (" ; Firma ", "'Dott. Mario Ros' || chr(CAST(97 + k % 26 AS INT)) || 'i'", "PERSON", 0.88),
    (" ; paziente: ", "'Giulia Ner' || chr(CAST(97 + k % 26 AS INT)) || 'i'", "PERSON", 0.75),
    (" ; Passaporto: ", "'YA' || d", "PASSPORT", 0.90),
    (" ; Personalausweis: ", "'CA' || d", "ID_CARD", 0.88),
    (" ; tessera ", "'1' || d || 'K'", "ID_CARD", 0.72),
    (" ; tessera ", "'X' || d || 'L'", "ID_CARD", 0.80),
    (" ; Patente: ", "'MI' || d || 'K'", "DRIVING_LICENSE", 0.85),
    (" ; Targa: ", f"'AB ' || {_THREE} || ' CD'", "PLATE", 0.82),
    (" ; SSN: ", f"'123-45-' || {_FOUR}", "TAX_ID", 0.90),
    (" ; codice ", f"'321-54-' || {_FOUR}", "TAX_ID", 0.78),
    (" ; codice ", "'AB' || right(d, 6) || 'C'", "TAX_ID", 0.82),
    (" ; VAT: ", "'GB' || d || '99'", "TAX_ID", 0.85),
    (" ; nir: ", f"'1 85 05 78 ' || {_THREE} || ' ' || {_THREE}", "TAX_ID", 0.88),
    (" ; nuss: ", "'28 ' || d", "TAX_ID", 0.85),
    (" ; host ", "'10.0.0.' || CAST(k % 256 AS STRING)", "IP", 0.85),
    (" ; host ", f"'FE80:0:0:0:0:0:0:' || {_FOUR}", "IP", 0.85),
    (" ; host ", f"'FE80::' || {_FOUR}", "IP", 0.80),
    (" ; host ", "'999.0.0.' || CAST(k % 256 AS STRING)", None, 0),
    (" ; scheda ", f"'00:1B:44:11:' || {_TWO} || ':B7'", "MAC", 0.92),
    (" ; sito ", "'https://a.example/x' || k", "URL", 0.85),
    (" ; sito ", "'www.site' || k || '.it'", "URL", 0.80),
    (" ; login: ", "'rossi.' || k", "USERNAME", 0.70),
    (" ; Matricola: ", "d", "EMPLOYEE_ID", 0.85),
    (" ; cartella clinica: ", "d", "MEDICAL_ID", 0.85),  # the value of the field before: one token for both
    (" ; rif. ", "'MED-' || d", "MEDICAL_ID", 0.78),
    (" ; polizza: ", "'P' || d", "INSURANCE_ID", 0.85),
    (" ; rif. ", "'INS-' || d", "INSURANCE_ID", 0.78),
    (" ; di nuovo ", "'ANN.k' || k || '@example.COM'", "EMAIL", 0.99),  # the first value in another spelling
    # A chain: the second amount ("500 euro") overlaps both, which do not overlap each other.
    (" ; anticipo ", "'€ 5' || right(d, 2)", "AMOUNT", 0.95),
    (" ", "'euro@chain' || k || '.it'", "EMAIL", 0.99),
    # A placeholder in the source stops every tenth text at the gate.
    (" ; nota ", "CASE WHEN k % 10 = 3 THEN '[PERSON_999]' ELSE 'nessuna' END", None, 0),
]
ORDER_FIELDS = [
    (" ; ordine: importo ", "left(CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING), 3)", "AMOUNT", 0.82),
    (" del ", f"{_text('extract(day FROM o_orderdate)', 2)} || '/' || {_text('extract(month FROM o_orderdate)', 2)}"
              " || '/' || CAST(extract(year FROM o_orderdate) AS STRING)", "DATE", 0.95),
]
#: Texts for the gate: one in ten holds a placeholder that nobody gave, one in seven a value inside a longer word.
GATE_FIELDS = [f for f in FIELDS if f[2] in ("EMAIL", "PHONE", "PERSON", "PASSPORT", "MAC", "URL")] + [
    (" ; nota ", "CASE WHEN k % 10 = 3 THEN '[PERSON_999]' ELSE 'nessuna' END", None, 0),
    (" ; archivio ", "CASE WHEN k % 7 = 2 THEN 'zYA' || d || 'z' ELSE 'nessuno' END", None, 0),
]
#: Types that only a lower threshold finds.
WEAK_FIELDS = [("CAP: ", f"'1' || {_FOUR}", "CAP", 0.65), (" ; profilo ", "'@ann_' || k", "USERNAME", 0.62), (" ; codice ", f"'12' || {_FOUR}", None, 0)]
#: Texts that a task makes and searches.
FORMS_EACH = 2_000
KEYS = "SELECT c_custkey AS k, lpad(CAST(c_custkey AS STRING), 7, '0') AS d FROM customer"


def _joined(fields: list) -> str:
    return " || ".join(f"'{before}' || {value}" for before, value, *_ in fields)


def forms(spark: SparkSession, folder: str, fields: list = FIELDS) -> DataFrame:
    """doc_id and text, one row per customer.

    Keys are dealt out before texts are made of them, so that a task gets no more than about FORMS_EACH texts.
    """
    key = F.col("c_custkey")
    customers = table(spark, folder, "customer").select(key.alias("k"), F.lpad(key.cast("string"), 7, "0").alias("d"))
    if fields is not FIELDS:
        return spread(customers, FORMS_EACH).select(F.col("k").alias("doc_id"), F.expr(_joined(fields)).alias("text"))
    tasks = parts(customers, FORMS_EACH)
    heads = customers.repartition(tasks, "k").select(F.col("k").alias("doc_id"), F.expr(_joined(fields)).alias("head"))
    lines = table(spark, folder, "orders").select("o_custkey", "o_orderkey", F.expr(_joined(ORDER_FIELDS)).alias("line"))
    told = lines.repartition(tasks, "o_custkey").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "line"))).alias("told"))
    joined = heads.join(told, F.col("doc_id") == F.col("o_custkey"), "left")
    return joined.select("doc_id", F.concat("head", F.coalesce(F.array_join("told.line", ""), F.lit(""))).alias("text"))


def pieces_sql(luhn, fields: list = FIELDS) -> str:
    """CTEs: made (doc_id, text) and raw finds as known by construction, in the form of oracles._numbered."""
    rows = []
    for i, (before, value, type_, confidence) in enumerate(fields):
        kind = (type_ or "").rstrip("?")
        found = "false" if type_ is None else "true" if kind == type_ else "k % 2 = 0" if kind in ("IBAN", "CF") else luhn(f"replace({value}, ' ', '')")
        rows.append(f"SELECT k AS doc_id, 0 AS line, {i} AS place, '{before}' AS before, CAST({value} AS VARCHAR) AS value, '{kind}' AS type, "
                    f"CAST({confidence} AS DOUBLE) AS c, {found} AS found FROM keyed")
    if fields is FIELDS:
        rows += [f"SELECT o_custkey, o_orderkey + 1, {i}, '{before}', {value}, '{type_}', CAST({confidence} AS DOUBLE), true FROM orders"
                 for i, (before, value, type_, confidence) in enumerate(ORDER_FIELDS)]
    return f"""
  keyed AS ({KEYS}),
  laid AS MATERIALIZED ({" UNION ALL ".join(rows)}),
  made AS MATERIALIZED (SELECT doc_id, string_agg(before || value, '' ORDER BY line, place) AS text FROM laid GROUP BY doc_id),
  finds AS MATERIALIZED (
    SELECT doc_id, type, c, 0 AS rank, stop - length(value) AS start, stop, value FROM (
      SELECT *, sum(length(before) + length(value)) OVER (PARTITION BY doc_id ORDER BY line, place) AS stop FROM laid)
    WHERE found)"""
