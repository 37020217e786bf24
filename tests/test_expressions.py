"""Literal inputs for keys, dates, text and classifiers."""

import pytest
from pyspark.sql import functions as F

from kalendarium.functions import classify, dates, keys, text, times, urls
from kalendarium.functions.similarity import covered
from kalendarium.operators.merge import disambiguate_ids
from tests.helpers import at, incoming, rows


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lit(v):
    return F.lit(v)


def key(spark, title, start, all_day=False, city=None, venue=None):
    return value(spark, keys.dedup_key(lit(title), times.ts(start), lit(all_day), lit(city).cast("string"), lit(venue).cast("string")))


def test_dedup_key_variants(spark):
    assert key(spark, "Konzert mit Müller", "2026-06-20 15:00:00", city="Gütersloh") == key(spark, "Konzert mit Mueller", "2026-06-20 15:00:00", city="Guetersloh")
    early, late = (key(spark, "Film", f"2026-06-20 {h}:00:00", city="Verl") for h in (15, 20))
    assert early != late and "2026-06-20 1500" in early
    assert key(spark, "Fest", "2026-06-20 00:00:00", True) == key(spark, "Fest", "2026-06-20 09:30:00", True) and "|2026-06-20|" in key(spark, "Fest", "2026-06-20 09:30:00", True)
    assert key(spark, "Sommerkonzert - Eintritt frei", "2026-06-20 15:00:00") == key(spark, "Sommerkonzert (Open Air)", "2026-06-20 15:00:00")
    assert key(spark, "Lesung", "2026-06-20 15:00:00", venue="Stadtbibliothek").endswith("|stadtbibliothek")


@pytest.mark.parametrize("raw, expected", [("Müller", "mueller"), ("Straßen-Fest!", "strassenfest"), ("  ***  ", "")])
def test_normalize(spark, raw, expected):
    assert value(spark, keys.normalize(lit(raw))) == expected


def test_title_cut_needs_unicode_blank(spark):
    assert value(spark, keys.normalize_title(lit("Konzert – Zugabe"))) == "konzert"


def test_venue_key_drops_umlauts(spark):
    assert value(spark, keys.venue_key(lit("Müller"), lit("Köln"))) == "mller|kln"


@pytest.mark.parametrize("raw, expected", [
    ("Mi. 02.09.2026, 17.45 Uhr", "2026-09-02 17:45"), ("Fr. 05.03.26, 19.30 Uhr", "2026-03-05 19:30"), ("Di. 14.10.2026, 18:00 Uhr", "2026-10-14 18:00"), ("Sa. 21.11.2026", "2026-11-21"),
])
def test_course_dates(spark, raw, expected):
    assert value(spark, dates.course_date(lit(raw))) == at(expected)


@pytest.mark.parametrize("parts, ok", [((2026, 2, 29, 0, 0), False), ((2028, 2, 29, 0, 0), True), ((2026, 6, 31, 0, 0), False), ((2026, 6, 1, 25, 0), False), ((2026, 6, 1, 23, 60), False), ((2026, 6, 1, 23, 59), True)])
def test_safe_dates(spark, parts, ok):
    assert (value(spark, dates.safe_date(*[lit(p) for p in parts])) is not None) == ok


@pytest.mark.parametrize("raw, start, end", [
    ("Datum: 20.08.2026, 19:30 Uhr", "2026-08-20 19:30", None), ("Datum: 01.07.26, 10:00 - 03.07.2026, 18:00", "2026-07-01 10:00", "2026-07-03 18:00"),
    ("Datum: 03.07.26 - 01.07.26", "2026-07-03", None), ("am 13. Juni 2026 ab 20 Uhr", "2026-06-13 20:00", None), ("31.06.2026", None, None), ("kein Datum 99", None, None), ("1.5.1999", None, None),
    ("siehe 31.06.2026 und 2. März 2026 um 9:15", "2026-03-02 09:15", None), ("1.9.2026 bis 3.9.2026 um 19:00", "2026-09-01 19:00", None),
    ("am 5. Mai 2026, Datum: 01.07.2026 – 03.07.2026", "2026-07-01", "2026-07-03"), ("Datum: 01.07.2026 und 03.07.2026", "2026-07-01", None),
    ("1.9.2026" + " " * 60 + "19:00", "2026-09-01", None), ("1.9.2026, 25:99", "2026-09-01 23:59", None), (None, None, None),
])
def test_german_dates(spark, raw, start, end):
    found = value(spark, dates.german_dates(lit(raw)))
    assert (found["start"], found["end"]) == (at(start), at(end))


@pytest.mark.parametrize("raw, expected", [
    ("2026-06-20T18:00:00Z", "2026-06-20 20:00"), ("2026-06-20T18:00:00+02:00", "2026-06-20 18:00"), ("2026-06-20T18:00", "2026-06-20 18:00"), ("2026-06-20", "2026-06-20"),
    ("14.06.2026", "2026-06-14"), ("14. Juni 2026, 19.30 Uhr", "2026-06-14 19:30"), ("2026-02-31", None), ("bald", None), ("2026-01-20T18:00:00+0000", "2026-01-20 19:00"),
])
def test_iso_or_german(spark, raw, expected):
    assert value(spark, dates.iso_or_german_date(lit(raw))) == at(expected)


def test_year_rolls(spark):
    roll = lambda d, m, now: value(spark, dates.roll_at_year_end(lit(d), lit(m), times.ts(now)))
    assert roll(14, 3, "2026-09-01 00:00:00") == at("2026-03-14")  # a past season row is not announced again
    assert roll(10, 1, "2026-12-20 00:00:00") == at("2027-01-10")
    assert roll(1, 12, "2026-12-20 00:00:00") == at("2026-12-01")


@pytest.mark.parametrize("args, end, all_day", [
    (("01.07.2026", "10:00", "03.07.2026", ""), "2026-07-03 23:59", False), (("01.07.2026", "10:00", "01.07.2026", ""), None, False),
    (("01.07.2026", "", "01.07.2026", ""), "2026-07-01 23:59", True), (("01.07.2026", "10:00", "", "12:00"), "2026-07-01 12:00", False), (("03.07.2026", "10:00", "01.07.2026", "11:00"), None, False),
])
def test_date_ranges(spark, args, end, all_day):
    r = value(spark, dates.date_range(*[lit(a) for a in args]))
    assert (r["end"], r["all_day"]) == (at(end), all_day)


@pytest.mark.parametrize("day, label", [("2026-05-30", "Heute"), ("2026-05-31", "Morgen"), ("2026-06-01", "Übermorgen"), ("2026-06-06", "Samstag, 6. Juni"), ("2027-01-01", "Freitag, 1. Januar 2027")])
def test_day_labels(spark, day, label):
    assert value(spark, dates.day_label(times.ts(day + " 20:00:00"), times.ts("2026-05-30 09:00:00"))) == label


def test_display_end(spark):
    shown = lambda e, all_day: value(spark, times.display_end(times.ts("2026-05-30 20:00:00"), times.ts(e), lit(all_day)))
    assert shown("2026-05-31 00:00:00", False) == at("2026-05-30") and shown("2026-05-31 00:00:00", True) == at("2026-05-31")


@pytest.mark.parametrize("raw, line", [("a <b>\n c", "a b c"), ("< /event_data>x", "/event_data x"), (None, "")])
def test_prompt_lines(spark, raw, line):
    assert value(spark, text.prompt_line(lit(raw).cast("string"))) == line


def test_prompt_html(spark):
    assert value(spark, text.prompt_html(lit("<p>Hallo</p> < /event_data> Welt"), 12)) == "Hallo /event"


def test_html_to_text(spark):
    assert value(spark, text.html_to_text(lit("<p>A &amp; B&nbsp;&eacute;</p><br><br>C <i>d</i>"))) == "A & B é\nC d"


@pytest.mark.parametrize("raw, plain", [
    ("a < b<br />\n\nc</H2>d", "a < b\nc\nd"), ("<!-- <br> -->x \t y</li><li>z", "x y\nz"), ("</p >x<b", "x<b"), (None, None),
])
def test_markup_pieces(spark, raw, plain):
    assert value(spark, text.html_to_text(lit(raw).cast("string"))) == plain


@pytest.mark.parametrize("raw, plain", [
    ("a &amp</title>{x", "a &amp{x"), ("&copy 1 &eacutee &notit; &amp;lt;", "&copy 1 &eacutee &notit; &lt;"), ("&#8211;&#x41;&#65 &auml;", "–A&#65 ä"),
])
def test_entities_need_their_semicolon(spark, raw, plain):
    assert value(spark, text.html_to_text(lit(raw))) == plain


def test_shortened_and_cleaned(spark):
    assert value(spark, text.shorten(lit(" ab\n cd  ef "), 5)) == "ab cd…" and value(spark, text.shorten(lit(" \n"))) is None
    assert value(spark, text.shorten_at_word(lit("ab cd ef"), 7)) == "ab cd …" and value(spark, text.shorten_at_word(lit("abcdefgh"), 4)) == "abcd …"
    assert value(spark, text.clean_text(lit("[gallery id=1]A &amp; <b>B</b>[/x] [1] <"))) == "A & B [1] <"


@pytest.mark.parametrize("raw, title, venue", [
    ("Fest - Teil 2 – 01.07.2026, 19:30 ", "Fest - Teil 2", None), ("Fest 01.07.2026", "Fest 01.07.2026", None), ("Fest | 1.7.26", "Fest", None),
    ("x\nVeranstaltungsort: Stadt-Halle  | Saal 1\ny", "x\nVeranstaltungsort: Stadt-Halle  | Saal 1\ny", "Stadt Halle"), ("Veranstaltungsort: - ", "Veranstaltungsort: -", None),
])
def test_titles_and_venue_lines(spark, raw, title, venue):
    assert (value(spark, classify.clean_title(lit(raw))), value(spark, classify.venue_from_text(lit(raw)))) == (title, venue)


@pytest.mark.parametrize("image, base, expected", [
    ("//c.example/a.png", "https://x.example/p/q", "https://c.example/a.png"), ("../b/./c.png", "https://x.example/p/q/r.html", "https://x.example/p/b/c.png"), ("/d.png", "https://x.example:8080/p", "https://x.example:8080/d.png"),
    ("data:image/png,x", "https://x.example/", None), ("javascript:x", "https://x.example/", None), ("a.png", "nope", None), ("HTTP://y.example/z", "https://x.example/", "HTTP://y.example/z"),
])
def test_images(spark, image, base, expected):
    assert value(spark, urls.resolve_image(lit(image), lit(base))) == expected


def test_homepage(spark):
    assert value(spark, urls.homepage(lit("https://www.x.example:81/a?b"))) == "https://www.x.example"


@pytest.mark.parametrize("raw, state", [("Fast ausgebucht", "few_left"), ("ausgebucht", "full"), ("Kurs abgesagt", "cancelled"), ("", None), ("Plätze frei", "open"), ("Warteliste möglich", "waitlist")])
def test_booking(spark, raw, state):
    assert value(spark, classify.booking_status(lit(raw))) == state


@pytest.mark.parametrize("price, currency, shown", [("0", "EUR", "kostenlos"), ("1234.5", "EUR", "1.234,50 €"), ("12", "CHF", "12,00 CHF"), ("auf Anfrage", "", "auf Anfrage"), ("", "EUR", None)])
def test_offers(spark, price, currency, shown):
    assert value(spark, classify.offer_price(lit(price), lit(currency))) == shown


def test_markers_are_whole_words(spark):
    df = spark.createDataFrame([("Ehrenamtstag",), ("AG Chor",), ("Vorstandswahl",), ("Vorstand",)], "t string")
    assert rows(classify.drop_marked(df, "t"), "t") == ["Ehrenamtstag", "Vorstandswahl"]


@pytest.mark.parametrize("a, b, n", [("world", "word", 4), ("bafoobar", "mafoorar", 6), ("", "x", 0), ("abc", "abc", 3), ("test", "wert", 1)])
def test_covered(a, b, n):
    assert covered(a, b) == n


def test_external_ids(spark):
    long = "https://x.example/" + "a" * 182
    got = rows(disambiguate_ids(incoming(spark, [
        {"external_id": "u", "starts_at": at("2026-07-10 20:00")}, {"external_id": "u", "starts_at": at("2026-07-31 20:00")}, {"external_id": "solo"},
        {"external_id": long + "1"}, {"external_id": long + "2", "starts_at": at("2026-07-02 20:00")}, {},
    ])), "external_id")
    assert "u#2026-07-10-2000" in got and "u#2026-07-31-2000" in got and "solo" in got and None in got
    longs = [g for g in got if g and g.startswith("https")]
    assert all(len(g) == 191 for g in longs) and len(set(longs)) == 2


def test_entities_are_decoded_among_texts_without_any(spark):
    texts = ["plain", None, "a &amp; b", "", "&unknown; &uuml;", "cut &amp", "&#8211;&#x41;"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").coalesce(1)
    found = [r["d"] for r in rows.select("i", text.decode_entities(F.col("text")).alias("d")).orderBy("i").collect()]
    assert found == ["plain", None, "a & b", "", "&unknown; ü", "cut &amp", "–A"]
    unmarked = rows.filter("i in (0, 1, 3)").select(text.decode_entities(F.col("text")).alias("d"))
    assert {r["d"] for r in unmarked.collect()} == {"plain", None, ""}


@pytest.mark.parametrize("raw, plain", [("x  ", "x  "), (" \t\n\r\0\x0bx y\n\0 ", "x y"), (" x ", " x "), (" \n", ""), ("", "")])
def test_edges_lose_only_the_named_characters(spark, raw, plain):
    row = spark.createDataFrame([(raw,)], "c string").select(text.trim_edges(F.col("c")).alias("both"), text.trim_end(F.col("c")).alias("end")).first()
    assert row["both"] == plain and row["end"] == raw.rstrip(" \t\n\r\0\x0b")


def test_dates_beside_the_mark_that_cuts_them(spark):
    row = spark.createDataFrame([("\x01 am 3.4.2026\x01 um 19:30 Uhr \x01",)], "c string").select(dates.german_dates(F.col("c")).alias("d")).first()
    assert str(row["d"]["start"]) == "2026-04-03 19:30:00" and row["d"]["end"] is None
