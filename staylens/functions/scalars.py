"""Row-level expressions: every one is ``Column -> Column`` over built-in
Spark SQL functions, so they compile into whole-stage code and never leave
the JVM. No Python UDF is used anywhere in the engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the source system's vocabulary and constants)
# ---------------------------------------------------------------------------
MALE_FIRST_NAMES = ["Juan", "Pedro", "Luis", "Carlos", "Jose", "Diego", "Jorge", "Miguel",
                    "Andres", "Felipe", "Rodrigo", "Sebastian", "Francisco", "Tomas",
                    "Nicolas", "Matias", "Cristobal", "Alvaro", "Rafael", "Hernan"]
FEMALE_FIRST_NAMES = ["Maria", "Ana", "Carmen", "Patricia", "Daniela", "Catalina", "Fernanda",
                      "Valentina", "Camila", "Sofia", "Isidora", "Francisca", "Antonia",
                      "Paula", "Javiera", "Carolina", "Andrea", "Beatriz", "Teresa", "Marcela"]
LAST_NAMES = ["Gonzalez", "Munoz", "Rojas", "Diaz", "Perez", "Soto", "Contreras", "Silva",
              "Martinez", "Sepulveda", "Gomez", "Vasquez", "Castillo", "Ramirez", "Herrera",
              "Gutierrez", "Castro", "Alvarez", "Romero", "Vargas"]
SEX_MALE, SEX_FEMALE = "Masculino", "Femenino"
ID_BODY_MIN, ID_BODY_MAX = 7_000_000, 27_000_000
BIRTH_YEAR_MIN, BIRTH_YEAR_MAX, BIRTH_YEAR_FLOOR, DEFAULT_REF_YEAR = 1935, 2015, 1900, 2010
EXCEL_EPOCH = "1899-12-30 00:00:00"
LOW_RISK, HIGH_RISK = 0.33, 0.66
TIER_LABELS = ["Baja", "Media", "Alta"]
TIER_UNKNOWN = "Desconocido"
UNKNOWN_CATEGORY = "Desconocido"
SEX_MALE_WORDS = ["m", "masculino", "h", "hombre"]
SEX_FEMALE_WORDS = ["f", "femenino", "mujer"]
SEX_MALE_LABEL, SEX_FEMALE_LABEL = "Hombre", "Mujer"
RISK_WORDS = {"bajo": 0.0, "baja": 0.0, "medio": 1.0, "media": 1.0, "alto": 2.0, "alta": 2.0}
ADMIN_CATEGORY_CODES = {"coordinacion_familiar": 1.0, "coordinacion_interinstitucional": 1.0,
                        "soporte_financiero": 2.0, "intervencion_psicosocial": 2.0,
                        "derivacion_apoyo_psicosocial": 2.0}
AGE_BAND_EDGES = [0, 30, 50, 70, 100]
AGE_BAND_LABELS = ["<30", "30-50", "50-70", "70+"]
# Text shapes of dates that aren't ISO, and the format each is read with (time optional):
# day first, month first with slashes if the second field can't be a month.
TIME_SHAPE = r"( [0-9]{1,2}:[0-9]{2}(:[0-9]{2})?)?$"
TEXT_DATES = [(r"^[0-9]{1,2}/(0?[1-9]|1[0-2])/[0-9]{4}" + TIME_SHAPE, "d/M/yyyy[ H:mm[:ss]]"),
              (r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}" + TIME_SHAPE, "d-M-yyyy[ H:mm[:ss]]"),
              (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}" + TIME_SHAPE, "M/d/yyyy[ H:mm[:ss]]")]
SERIAL_LIMIT_DAYS = 106751                  # representable offset from the epoch
# Text shapes taken for a date in unmapped columns: a serial number, ISO, dd/mm/yyyy.
SERIAL_SHAPE = r"^[0-9]{5}(\.[0-9]+)?$"
DATE_SHAPES = [r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2})?)?$",
               r"^[0-9]{2}/[0-9]{2}/[0-9]{4}(\s+[0-9]{2}:[0-9]{2}(:[0-9]{2})?)?$"]
# ---------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c) -> Column:
    """Spark NaN is an ordinary (largest) value; missing numbers must be NULL."""
    c = _c(c)
    return F.nanvl(c, F.lit(None).cast("double"))


def clip(c, lo=None, hi=None) -> Column:
    """NULL-preserving clip (``greatest``/``least`` would skip a NULL)."""
    c = _c(c)
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    if hi is not None:
        out = F.least(out, F.lit(hi))
    return F.when(c.isNotNull(), out)


# --- text ------------------------------------------------------------------
def blank_to_null_ingest(c) -> Column:
    """P13 (ingest): exactly the empty string becomes NULL; blanks are kept."""
    return F.nullif(_c(c), F.lit(""))


def blank_to_null_read(c) -> Column:
    """P13 (read): any whitespace-only text becomes NULL."""
    c = _c(c)
    return F.when(F.trim(c) == "", F.lit(None)).otherwise(c)


def upper_trim(c) -> Column:
    """X11: upper-cased, trimmed; empty result is NULL."""
    return F.nullif(F.upper(F.trim(_c(c))), F.lit(""))


def first_truthy(*cols) -> Column:
    """First value that is neither NULL nor the empty string."""
    return F.coalesce(*[F.nullif(_c(c).cast("string"), F.lit("")) for c in cols])


def fill_unknown(c, label: str = UNKNOWN_CATEGORY) -> Column:
    """Missing category text gets one fixed spelling."""
    return F.coalesce(_c(c).cast("string"), F.lit(label))


def normalize_sex(c) -> Column:
    """m/masculino/h/hombre -> Hombre, f/femenino/mujer -> Mujer, else as given."""
    c = _c(c)
    key = F.lower(F.trim(c))
    return (F.when(c.isNull(), F.lit(UNKNOWN_CATEGORY))
            .when(key.isin(SEX_MALE_WORDS), F.lit(SEX_MALE_LABEL))
            .when(key.isin(SEX_FEMALE_WORDS), F.lit(SEX_FEMALE_LABEL))
            .otherwise(c))


def category_features(sexo="sexo", servicio_clinico="servicio_clinico", prevision="prevision") -> list[Column]:
    """The three category features as models know them, for training (M1) and scoring
    (M20) alike: one spelling of unknown (X26), sexes by X12."""
    return [normalize_sex(_c(sexo).cast("string")).alias("sexo"), fill_unknown(servicio_clinico).alias("servicio_clinico"),
            fill_unknown(prevision).alias("prevision")]


# --- numbers ---------------------------------------------------------------
def lenient_int(c) -> Column:
    """Keep only digits and '-', then parse; anything else is NULL.

    ``"12.5"`` -> 125, ``" $53.052.920 "`` -> 53052920, ``"--5"`` -> NULL.
    """
    return F.regexp_replace(_c(c).cast("string"), r"[^0-9-]", "").try_cast("bigint")


def lenient_float(c) -> Column:
    """Decimal comma accepted; only plain decimal text is a number."""
    s = F.regexp_replace(F.trim(_c(c).cast("string")), ",", ".")
    ok = s.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    return F.when(ok, nan_to_null(s.try_cast("double")))


def serial_days_to_timestamp(v) -> Column:
    """Days since 1899-12-30 as a number -> timestamp floored to the second."""
    v = _c(v)
    secs = F.floor(v * F.lit(86400.0)).cast("bigint")
    return F.when(F.abs(v) <= F.lit(SERIAL_LIMIT_DAYS),
                  F.timestamp_add("SECOND", secs, F.to_timestamp_ntz(F.lit(EXCEL_EPOCH))))


def excel_serial_to_timestamp(c, with_time: bool = True) -> Column:
    """Days since 1899-12-30 (decimal comma allowed), floored to the second."""
    ts = serial_days_to_timestamp(lenient_float(c))
    return ts if with_time else ts.cast("date")


def parse_datetime(c, keep_time: bool = True, serials: bool = True) -> Column:
    """A serial number (any that is representable), else ISO text, else day-first text.

    ISO is read as ISO (an offset suffix is dropped, wall time kept); slashes
    and dashes in ``d/M/yyyy`` order are day-first, with month-first as the
    fallback when the second field cannot be a month. A format is tried only on text
    of its shape: a failing one costs an exception per row.
    """
    s = F.trim(_c(c).cast("string"))
    text = F.when(s.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), s.try_cast("timestamp_ntz"))
    for shape, fmt in TEXT_DATES:
        # Parsed in the session zone and cast back: the wall-clock time is kept.
        text = text.when(s.rlike(shape), F.try_to_timestamp(s, F.lit(fmt)).cast("timestamp_ntz"))
    ts = F.coalesce(serial_days_to_timestamp(lenient_float(s)), text) if serials else text
    return ts if keep_time else ts.cast("date")


def looks_like_date(c, serials: bool = True) -> Column:
    """ISO date(-time), dd/mm/yyyy(-time) or, with ``serials``, a 5-digit serial."""
    shapes = [SERIAL_SHAPE] * serials + DATE_SHAPES
    return F.coalesce(F.trim(_c(c).cast("string")).rlike("|".join(shapes)), F.lit(False))


def iso_text(ts) -> Column:
    """Render a timestamp as ``YYYY-MM-DDTHH:MM:SS`` (sink-side formatting)."""
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss")


def carried_value(c, serials: bool = True) -> Column:
    """X5 applied to an unmapped column: date-like text becomes ISO text; bare
    5-digit numbers, which may be codes, only with ``serials``."""
    return F.when(looks_like_date(c, serials), iso_text(parse_datetime(c, True))).otherwise(blank_to_null_ingest(c))


def allowed_stay_days(c) -> Column:
    """A number as is; a date gives its day of month."""
    s = _c(c).cast("string")
    num = lenient_float(s)
    return F.coalesce(num, F.dayofmonth(parse_datetime(s, keep_time=False, serials=False)).cast("double"))


def encode_risk(c) -> Column:
    """Number as is, bajo/a 0, medio/a 1, alto/a 2, else NULL; clipped to 0..2."""
    s = _c(c).cast("string")
    num = lenient_float(s)
    words = F.create_map(*[x for k, v in RISK_WORDS.items() for x in (F.lit(k), F.lit(v))])
    word = F.element_at(words, F.lower(F.trim(s)))
    return clip(F.coalesce(num, word), 0.0, 2.0)


# --- identity --------------------------------------------------------------
def seed_from_key(c) -> Column:
    """First 12 hex digits of SHA-1 of the key, as a 48-bit integer."""
    k = F.coalesce(_c(c).cast("string"), F.lit(""))
    return F.conv(F.substring(F.sha1(k), 1, 12), 16, 10).cast("bigint")


def _second_seed(c) -> Column:
    k = F.coalesce(_c(c).cast("string"), F.lit(""))
    return F.conv(F.substring(F.sha1(k), 13, 12), 16, 10).cast("bigint")


def check_digit(num) -> Column:
    """Modulo-11 check digit, weights 2..7 from the right; 11 -> '0', 10 -> 'K'."""
    digits = F.split(F.reverse(_c(num).cast("string")), "")
    weighted = F.transform(digits, lambda d, i: d.cast("int") * (i % 6 + 2))
    total = F.aggregate(weighted, F.lit(0), lambda acc, x: acc + x)
    dv = F.lit(11) - total % 11
    return (F.when(dv == 11, F.lit("0")).when(dv == 10, F.lit("K"))
            .otherwise(dv.cast("string")))


def synthetic_identity(episode, age=None, record_ts=None) -> Column:
    """Deterministic identity drawn from hashes of the episode key.

    Returns a struct (run, nombre, sexo, fecha_de_nacimiento). Draw order:
    sex, first name, surname, id body, birth date.
    """
    seed = seed_from_key(episode)
    seed2 = _second_seed(episode)
    male = (seed % 2) == 0
    first = F.when(male, F.element_at(F.array(*map(F.lit, MALE_FIRST_NAMES)),
                                      (_idiv(seed, 2) % 20 + 1).cast("int"))) \
        .otherwise(F.element_at(F.array(*map(F.lit, FEMALE_FIRST_NAMES)),
                                (_idiv(seed, 2) % 20 + 1).cast("int")))
    last = F.element_at(F.array(*map(F.lit, LAST_NAMES)), (_idiv(seed, 40) % 20 + 1).cast("int"))
    body = F.lit(ID_BODY_MIN) + _idiv(seed, 800) % (ID_BODY_MAX - ID_BODY_MIN + 1)
    run = F.concat(body.cast("string"), F.lit("-"), check_digit(body))
    sexo = F.when(male, F.lit(SEX_MALE)).otherwise(F.lit(SEX_FEMALE))
    return F.struct(run.alias("run"), F.concat_ws(" ", first, last).alias("nombre"),
                    sexo.alias("sexo"),
                    birthdate(seed2, age, record_ts).alias("fecha_de_nacimiento"))


def birthdate(seed2, age=None, record_ts=None) -> Column:
    """Year from age and record year (floor 1900), else a drawn year; month 1-12, day 1-28."""
    seed2 = _c(seed2)
    ref_year = F.coalesce(F.year(_c(record_ts)), F.lit(DEFAULT_REF_YEAR)) if record_ts is not None \
        else F.lit(DEFAULT_REF_YEAR)
    drawn = F.lit(BIRTH_YEAR_MIN) + seed2 % (BIRTH_YEAR_MAX - BIRTH_YEAR_MIN + 1)
    if age is not None:
        a = _c(age)
        year = F.when(a.isNotNull(),
                      F.greatest(F.lit(BIRTH_YEAR_FLOOR),
                                 ref_year - F.greatest(F.lit(0), a.cast("int")))).otherwise(drawn)
    else:
        year = drawn
    month = _idiv(seed2, 81) % 12 + 1
    day = _idiv(seed2, 972) % 28 + 1
    return F.make_date(year.cast("int"), month.cast("int"), day.cast("int"))


# --- labels, weights and codes ---------------------------------------------
def excess_label(stay, norm) -> Column:
    """1 when the stay exceeds the norm, missing -> 0."""
    return F.coalesce((_c(stay) > _c(norm)).cast("int"), F.lit(0))


def sample_weight(stay, norm) -> Column:
    """clip(1 + 0.05 * max(0, stay - norm), 1, 3); missing excess counts as 0."""
    excess = F.coalesce(clip(nan_to_null(_c(stay).cast("double") - _c(norm).cast("double")), 0.0), F.lit(0.0))
    return F.least(F.greatest(F.lit(1.0) + F.lit(0.05) * excess, F.lit(1.0)), F.lit(3.0))


def tercile_code(v, q33, q66, default: float = 1.0) -> Column:
    """0 / 1 / 2 against two cut points; q66 <= q33 moves q66 up by 1e-6."""
    v, q33, q66 = _c(v), _c(q33), _c(q66)
    q66 = F.when(q66 <= q33, q33 + F.lit(1e-6)).otherwise(q66)
    return (F.when(v.isNull() | q33.isNull(), F.lit(default))
            .when(v <= q33, F.lit(0.0)).when(v <= q66, F.lit(1.0)).otherwise(F.lit(2.0)))


def clinical_code(v) -> Column:
    """clip(v - 1, 0, 2), missing -> 1."""
    return F.coalesce(clip(nan_to_null(_c(v).cast("double")) - F.lit(1.0), 0.0, 2.0), F.lit(1.0))


def admin_code(gestion, category) -> Column:
    """max(1 if gestion = 'si', code of the category)."""
    g = F.lower(F.trim(_c(gestion).cast("string")))
    cat = F.lower(F.trim(_c(category).cast("string")))
    codes = F.create_map(*[x for k, v in ADMIN_CATEGORY_CODES.items() for x in (F.lit(k), F.lit(v))])
    base = F.when(g == "si", F.lit(1.0)).otherwise(F.lit(0.0))
    return F.greatest(base, F.coalesce(F.element_at(codes, cat), F.lit(0.0)))


# --- bins -------------------------------------------------------------------
def tier_vector(p, low: float = LOW_RISK, high: float = HIGH_RISK) -> Column:
    """[0, low] Baja, (low, high] Media, (high, 1] Alta, else NULL."""
    p = _c(p)
    return (F.when((p >= 0) & (p <= low), F.lit(TIER_LABELS[0]))
            .when((p > low) & (p <= high), F.lit(TIER_LABELS[1]))
            .when((p > high) & (p <= 1), F.lit(TIER_LABELS[2])))


def tier_scalar(p, low: float = LOW_RISK, high: float = HIGH_RISK) -> Column:
    """< low Baja, <= high Media, else Alta; missing -> Desconocido."""
    p = nan_to_null(_c(p))
    return (F.when(p.isNull(), F.lit(TIER_UNKNOWN)).when(p < low, F.lit(TIER_LABELS[0]))
            .when(p <= high, F.lit(TIER_LABELS[1])).otherwise(F.lit(TIER_LABELS[2])))


def age_band(age) -> Column:
    """Right-closed bands (0,30] (30,50] (50,70] (70,100]."""
    a = _c(age)
    out = None
    for lo, hi, lab in zip(AGE_BAND_EDGES[:-1], AGE_BAND_EDGES[1:], AGE_BAND_LABELS):
        cond = (a > lo) & (a <= hi)
        out = F.when(cond, F.lit(lab)) if out is None else out.when(cond, F.lit(lab))
    return out


def right_closed_bin(p, edges_col) -> Column:
    """Bin index = number of inner edges strictly below ``p`` (right-closed bins,
    lowest value included); ``edges_col`` is an array column of all edges."""
    e, p = _c(edges_col), _c(p)
    inner = F.slice(e, F.lit(2), F.greatest(F.size(e) - 2, F.lit(0)))
    return F.size(F.filter(inner, lambda x: x < p))


def utc_iso(ts) -> Column:
    """UTC ISO text of a session-zone timestamp."""
    return F.date_format(F.to_utc_timestamp(_c(ts), "UTC"), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _idiv(c, k: int) -> Column:
    """Exact integer division of a non-negative BIGINT below 2^53."""
    c = _c(c)
    return ((c - c % k) / F.lit(k)).cast("bigint")


def row_id(*keys) -> Column:
    """Deterministic record id from the business key (stands in for the
    store's object id): SHA-256 of the key fields joined by '|'."""
    return F.sha2(F.concat_ws("|", *[_c(k).cast("string") for k in keys]), 256)
