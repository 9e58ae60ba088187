"""Domain-shaped inputs derived from the given parquet tables.

:class:`Views` builds them as DataFrames.  ``SQL`` holds the same definitions as SQL text for the
oracle; :func:`with_views` puts the ones a statement mentions in front of it.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from labelspark.sources.ledger import data_lines
from labelspark.stage import Stages


def _text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


class Views:
    """Lazily defined inputs over one folder of parquet tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def provider(self) -> DataFrame:
        key = F.col("c_custkey")
        form = F.when(key % 4 == 0, " GmbH").when(key % 4 == 1, " AG").when(key % 4 == 2, " GmbH & Co. KG").otherwise("")
        segment = F.col("c_mktsegment")
        review = (F.when(segment == "BUILDING", "geprueft").when(segment == "MACHINERY", "beanstandet")
                  .when(segment == "HOUSEHOLD", F.lit(None)).otherwise("offen"))
        nations = self.table("nation").select("n_nationkey", "n_name")
        return self.table("customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
            key.alias("id"),
            F.concat("c_name", form).alias("name"),
            F.col("n_name").alias("city"),
            F.when(key % 5 != 0, F.concat(F.lit("12 "), _text(key))).alias("file_number"),
            (50 + 10 * (key % 6)).cast("int").alias("priority"),
            review.alias("review_status"),
            (F.col("c_acctbal") >= 0).alias("active"),
        )

    @cached_property
    def job(self) -> DataFrame:
        status, key = F.col("o_orderstatus"), F.col("o_orderkey")
        priority = F.col("o_orderpriority")
        message = (
            F.when(priority == "1-URGENT", "Timeout nach 2 Min.").when(priority == "2-HIGH", "Keine Ergebnisse gefunden")
            .when(priority == "3-MEDIUM", "duplicate key value violates unique constraint")
            .when(priority == "5-LOW", F.lit(None)).otherwise("Suchmaschinen nicht erreichbar oder blockiert")
        )
        # every tenth supplier has no job: its orders go to the one before
        owner = F.col("o_custkey") - (F.col("o_custkey") % 10 == 0).cast("int")
        return self.table("orders").select(
            key.alias("id"), owner.alias("provider_id"),
            F.when(status == "O", "success").when(status == "P", "partial").when(key % 7 == 0, "running")
            .otherwise("failed").alias("status"),
            message.alias("log_message"), F.col("o_orderdate").alias("started_at"),
        )

    @cached_property
    def mix(self) -> DataFrame:
        # line items shrink to one row per order before they meet the orders
        items = self.table("lineitem").groupBy("l_orderkey").agg(
            F.min("l_quantity").alias("_low"), F.max("l_quantity").alias("_high"), F.max("l_discount").alias("_disc"))
        rows = self.table("orders").select("o_orderkey", "o_custkey", "o_orderdate").join(
            items, F.col("o_orderkey") == F.col("l_orderkey"))
        key, low, high = F.col("o_orderkey"), F.col("_low"), F.col("_high")
        share = "decimal(5,2)"
        return rows.select(
            key.alias("id"), F.col("o_custkey").alias("provider_id"),
            F.when(key % 9 != 0, F.expr("o_orderkey div 60")).alias("document_id"),
            (F.year("o_orderdate") + 24).cast("int").alias("year"),
            (2 * low).cast(share).alias("renewable_percentage"),
            (100 - 2 * low).cast(share).alias("fossil_percentage"),
            (100 * F.col("_disc")).cast(share).alias("nuclear_percentage"),
            low.cast(share).alias("wind_percentage"),
            high.cast(share).alias("coal_percentage"),
            low.cast(share).alias("hkn_percentage"),
            (10 * high).cast("decimal(6,2)").alias("co2_emission_g_kwh"),
            (key % 101).cast("int").alias("confidence"),
            F.when(key % 4 == 0, "manual").when(key % 4 == 1, "regex").when(key % 4 == 2, "ocr").otherwise("gemini_text")
            .alias("extraction_method"),
            F.when(key % 11 == 0, "unbestaetigt").when(key % 11 == 1, "bestaetigt").alias("source_status"),
            F.col("o_orderdate").alias("created_at"),
        )

    @cached_property
    def delivery(self) -> DataFrame:
        return self.table("orders").groupBy(
            F.col("o_custkey").alias("provider_id"), (F.year("o_orderdate") + 24).cast("int").alias("year")
        ).agg(F.sum(F.col("o_totalprice").cast("decimal(15,2)")).cast("decimal(15,2)").alias("delivered_volume_mwh"))

    @cached_property
    def cancellation(self) -> DataFrame:
        countries = self.table("supplier").select("s_suppkey", "s_nationkey").join(
            self.table("nation").select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"))
        items = self.table("lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
        orders = self.table("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        return (
            items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(countries, F.col("l_suppkey") == F.col("s_suppkey"))
            .groupBy(F.col("o_custkey").alias("provider_id"), (F.year("o_orderdate") + 24).cast("int").alias("year"),
                     F.col("n_name").alias("country"))
            .agg((F.sum(F.col("l_quantity").cast("decimal(15,2)")) * 100).cast("decimal(15,2)").alias("amount_mwh"))
        )

    @cached_property
    def audit(self) -> DataFrame:
        # verdicts for every third supplier
        key = F.greatest(F.lit(3), F.col("o_custkey") - F.col("o_custkey") % 3)
        return self.table("orders").select(
            key.alias("provider_id"), (F.year("o_orderdate") + 24).cast("int").alias("year"),
            F.when(key % 4 == 0, "plausibel").when(key % 4 == 1, "fehlerhaft_hkn").otherwise("beanstandet").alias("status"),
        ).distinct()

    @cached_property
    def doc(self) -> DataFrame:
        key = F.col("doc_id")
        return self.table("documents").select(
            key.alias("id"), (key % 97).alias("provider_id"),
            F.when(key % 5 == 0, "image").when(key % 5 == 1, "manual").otherwise("pdf").alias("file_type"),
            F.sha2("text", 256).alias("file_hash"),
            F.concat(F.lit("https://www.host"), _text(key % 13), F.lit(".de/skz/"), "source", F.lit(".pdf")).alias("source_url"),
            F.when(key % 8 != 0, (2019 + key % 7).cast("int")).alias("reporting_year"),
            "text",
        )

    @cached_property
    def jobdoc(self) -> DataFrame:
        """Documents stored around the time of the order they belong to."""
        key = F.col("o_orderkey")
        shift = F.make_dt_interval(secs=(key % 180 - 90).cast("decimal(18,6)"))
        return self.table("orders").select(
            key.alias("id"), F.col("o_custkey").alias("provider_id"), (F.col("o_orderdate") + shift).alias("created_at"))

    @cached_property
    def trusted(self) -> DataFrame:
        # sources are confirmed for every second supplier
        key = F.col("doc_id") % 97 - F.col("doc_id") % 97 % 2
        return self.table("documents").select(
            key.alias("provider_id"), F.concat(F.lit("host"), _text(key % 13), F.lit(".de")).alias("domain")).distinct()

    @cached_property
    def token(self) -> DataFrame:
        key = F.col("id")
        name = F.when(key % 50 == 0, "Stand 2024").when(key % 53 == 0, "AB").otherwise(F.col("name"))

        def token(k: int, x: float, text: Column, when: Column | None = None) -> Column:
            t = F.struct((10 * key + k).alias("seq"), F.lit(x).alias("x"),
                         ((key % 40) * 1.5 + 0.01 * k).alias("y"), text.alias("text"))
            return t if when is None else F.when(when, t)

        tokens = F.array(
            token(0, 3.5, name), token(1, 6.0, F.lit("Zweitname"), key % 11 == 0),
            token(2, 24.6, F.concat(F.lit(" Weg "), _text(key)), key % 7 != 0),
            # the last five digits: lpad would keep the first ones of a longer number
            token(3, 35.5, F.right(F.concat(F.lit("00000"), _text(key)), F.lit(5))), token(4, 39.4, F.col("city")))
        return self.provider.select(F.expr("id div 40").alias("page"), F.explode(tokens).alias("t")).filter(
            F.col("t").isNotNull()).select("page", "t.*")

    @cached_property
    def ledger(self) -> DataFrame:
        """Ledger lines, one ledger per year, with header, blank lines, gaps and repeated lines."""
        nations = self.table("nation").select(F.col("n_name").alias("country"), "n_nationkey")
        # the small sides meet first, so that the cancellations are shuffled for one join only
        named = self.delivery.join(self.provider.select(F.col("id").alias("provider_id"), "name"), "provider_id")
        rows = self.cancellation.join(nations, "country").join(named, ["provider_id", "year"])
        key = F.col("provider_id")
        name = F.when(key % 19 == 0, F.concat(F.lit("Unbekannt "), _text(key))).otherwise(F.upper("name"))
        country = F.when(key % 17 == 0, F.lit("")).otherwise(F.concat(F.lit(" "), "country"))
        line = F.concat_ws(",", name, _text("year"), _text("delivered_volume_mwh"), country, _text("amount_mwh"), F.lit("x"))
        number = key * 100 + F.col("n_nationkey") + 10
        odd = F.when(key % 46 == 0, "1e30").when(key % 69 == 0, "viel").otherwise("7.50")
        again = F.concat_ws(",", name, _text("year"), odd, country, F.lit("1.25"))
        lines = rows.select(
            F.col("year").alias("ledger_id"),
            F.explode(F.array(
                F.struct(number.alias("line_no"), F.concat(F.lit("  "), line).alias("line")),
                F.struct((number + 10**12).alias("line_no"), F.when(key % 23 == 0, again).otherwise("  ").alias("line")),
            )).alias("l")).select("ledger_id", "l.*")
        years = self.table("orders").select((F.year("o_orderdate") + 24).cast("int").alias("ledger_id")).distinct()
        header = years.select(
            "ledger_id", F.lit(1).cast("long").alias("line_no"),
            F.lit("anbieter_name,berichtsjahr,strommenge_mwh,hkn_land,hkn_menge_mwh").alias("line"))
        return lines.unionByName(header)

    @cached_property
    def ledger_data(self) -> DataFrame:
        """The ledger's data lines; all lines are written once, since their header is looked for first."""
        stages = Stages(self.spark)
        return data_lines(stages.write(self.ledger, "lines"), stages)

    @cached_property
    def response(self) -> DataFrame:
        key = F.col("id")
        body = F.concat(
            F.lit('{"is_skz": '), F.when(key % 13 == 0, "false").otherwise("true"),
            F.lit(', "year": '), _text("year"), F.lit(', "renewable": '), _text("renewable_percentage"),
            F.lit(', "fossil": '), _text("fossil_percentage"), F.lit(', "nuclear": '), _text("nuclear_percentage"),
            F.lit(', "wind": '), _text("wind_percentage"), F.lit(', "coal": '), _text("coal_percentage"),
            F.lit(', "co2": '), _text("co2_emission_g_kwh"),
            F.when(key % 3 == 0, ', "radioactive_waste": 0.0007').otherwise(', "waste": 0.0005, "radioactive_waste": 0.9'),
            F.when(key % 2 == 0, F.concat(F.lit(', "ee_with_hkn": '), _text("hkn_percentage"))).otherwise(', "hkn": 7.5, "ee_with_hkn": 1'),
            F.when(key % 4 == 0, "").otherwise(F.concat(F.lit(', "confidence": '), _text("confidence"))),
            F.when(key % 5 == 0, ', "hkn_origins": [{"country": "Norwegen", "percentage": 60.5}]')
            .when(key % 5 == 1, ', "hkn_origins": "Norwegen"').otherwise(', "hkn_origins": null'),
            F.lit("}"),
        )
        broken = F.when(key % 17 == 0, F.lit('{"year": ')).otherwise(body)
        fenced = F.when(key % 6 < 3, F.concat(F.lit("```json\n"), broken, F.lit("\n```"))).otherwise(broken)
        return self.mix.select("id", fenced.alias("raw_response"))

    @cached_property
    def label_text(self) -> DataFrame:
        """Whole documents, three of four followed by a printed label."""
        key = F.col("doc_id")
        fossil = 995 - 10 * (key % 60) - 10 * (key % 10)
        ee = F.concat(_text(key % 60), F.lit(",5"))
        nu = _text(key % 10)
        fo = F.concat(_text(F.expr("(995 - 10 * (doc_id % 60) - 10 * (doc_id % 10)) div 10")), F.lit(","), _text(fossil % 10))
        year = _text(2019 + key % 6)
        forward = F.concat(
            F.lit("\nStromkennzeichnung Berichtsjahr "), year, F.lit("\nGesamtenergieträgermix: Erneuerbare Energien: "), ee,
            F.lit(" %\nKernenergie: "), nu, F.lit(" %\nFossile Energieträger:  "), fo, F.lit(" %\ndavon Windkraft: "), nu,
            F.lit(".5 % CO2-Emissionen: "), _text(100 + key % 400),
            F.lit(" g/kWh, Radioaktiver Abfall: 0,0003 mg/kWh Bundesmix Deutschland Erneuerbare Energien 44,1 %"))
        backward = F.concat(
            F.lit(" Lieferung "), year, F.lit(" Unternehmensmix "), ee, F.lit(" % Erneuerbare Energien, "), nu,
            F.lit(" % Kernkraft, "), fo, F.lit(" % Fossile Energien. Bundesmix 1 % Kernkraft"))
        bare = F.concat(F.lit(" Zeitraum "), year, F.lit(" EE-Anteil 100 %"))
        label = F.when(key % 4 == 0, forward).when(key % 4 == 1, backward).when(key % 4 == 3, bare).otherwise("")
        return self.table("documents").select(key.alias("doc_id"), F.concat("text", label).alias("text"))

    @cached_property
    def result(self) -> DataFrame:
        """Search results: per document one address found for its supplier."""
        names = self.provider.select(F.col("id").alias("provider_id"), "name")
        rows = self.doc.select("id", "provider_id", "source_url").join(names, "provider_id")
        key = F.col("id")
        host = F.lower(F.regexp_replace("name", "[^A-Za-z0-9]", ""))
        own = F.concat(F.lit("https://www."), host, F.lit(".de/stromkennzeichnung.pdf"))
        escaped = F.replace(F.replace(own, F.lit(":"), F.lit("%3A")), F.lit("/"), F.lit("%2F"))
        packed = F.regexp_replace(F.base64(own.cast("binary")), "[=\r\n]", "")
        url = (
            F.when(key % 7 == 0, F.concat(F.lit("https://cdn.example.net/files/"), F.replace(F.col("name"), F.lit("#"), F.lit("")),
                                          F.lit("/Strommix.pdf/1b01?download=true")))
            .when(key % 7 == 1, F.concat(F.lit("https://duckduckgo.com/l/?uddg="), escaped, F.lit("&rut=123")))
            .when(key % 7 == 2, F.concat(F.lit("https://www.bing.com/ck/a?!&&p=5812&u=a1"), packed, F.lit("&ntb=1")))
            .when(key % 7 == 3, F.concat(F.lit("https://de.wikipedia.org/wiki/"), host))
            .when(key % 7 == 4, F.concat(F.lit("https://"), host, F.lit(".de/agb/tarif")))
            .when(key % 7 == 5, F.concat(F.lit("https://www."), host, F.lit(".de/")))
            .otherwise(F.col("source_url"))
        )
        return rows.select("provider_id", key.alias("position"), url.alias("url"),
                           F.concat("name", F.lit(" Stromkennzeichnung")).alias("query"))

    @cached_property
    def link(self) -> DataFrame:
        """Link rows of supplier pages; three documents share an address."""
        key = F.col("doc_id")
        n = _text(F.expr("doc_id div 24"))
        base = F.lit("https://www.host.de/")
        href = (
            F.when(key % 8 == 0, F.concat(base, F.lit("stromkennzeichnung-"), n, F.lit(".pdf")))
            .when(key % 8 == 1, F.concat(base, F.lit("energiemix-"), n, F.lit(".PNG?x=1")))
            .when(key % 8 == 2, F.concat(base, F.lit("pdf/bericht-"), n))
            .when(key % 8 == 3, F.concat(base, F.lit("logo-strommix-"), n, F.lit(".png")))
            .when(key % 8 == 4, F.concat(base, F.lit("kennzeichnung-"), n, F.lit(".html")))
            .when(key % 8 == 5, F.concat(base, F.lit("download/"), n, F.lit(".pdf?v=2")))
            .when(key % 8 == 6, F.concat(base, F.lit("bild-"), n, F.lit(".jpeg")))
            .otherwise(F.concat(base, F.lit("nachweis-"), n, F.lit(".pdf")))
        )
        return self.table("documents").select(
            F.expr("doc_id div 48").alias("page_id"), key.alias("position"), href.alias("href"),
            F.when(key % 5 == 0, "strommix herunterladen").otherwise("download").alias("text"),
            F.when(key % 8 == 5, "stromkennzeichnung 2024").otherwise("").alias("title"),
            F.when(key % 8 == 6, "energiemix als bild").otherwise("").alias("aria_label"),
            F.when(key % 9 == 0, "energiequelle").otherwise("").alias("alt"),
        )

    @cached_property
    def known_page(self) -> DataFrame:
        """Pages built around whole documents, so that their text and links are known without reading markup."""
        key = F.col("doc_id")
        written = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
        title = F.lit("<title>Titel</title>")
        link = F.concat(F.lit(" href="), F.when(key % 2 == 0, F.concat(F.lit('" \n/d/'), _text(key), F.lit('.pdf?a=1&amp;b\t=2\x0b "')))
                        .otherwise(F.concat(F.lit("'../d/"), _text(key), F.lit(".pdf'"))))
        anchor = (
            F.when(key % 5 == 0, F.concat(F.lit('<a title="a > b"'), link, F.lit(">Strommix</a>")))
            .when(key % 5 == 1, F.concat(F.lit('<a title="data href=/wrong.pdf"'), link, F.lit(">Strommix</a>")))
            .when(key % 5 == 2, F.concat(F.lit("<A\n DATA-HREF=/no.pdf"), link, F.lit(" class=x>Strommix<a name=y>")))
            .when(key % 5 == 3, F.concat(F.lit("<!-- <a href='/no.pdf'>nein</a> --><a"), link, F.lit("><b>Strom</b>mix</a>")))
            .otherwise(F.concat(F.lit("<script>x = '<a href=\"/no.pdf\">';</script><a rel='x>y'"), link, F.lit(">Strommix</a>"))))
        html = (
            F.when(key % 6 == 0, F.concat(F.lit("<html><head>"), title, F.lit("</head><body>"), anchor, F.lit(" "), written, F.lit("</body></html>")))
            .when(key % 6 == 1, F.concat(F.lit("<head>"), title, F.lit('<meta name="x" content="b > c"><body class="x>y"><p>'), anchor, F.lit("\n"), written))
            .when(key % 6 == 2, F.concat(F.lit("<p title=\"a > b\" data-x='q > r'>"), anchor, F.lit(" "), written,
                                         F.lit('</p><!-- <b>nein</b> --><script type="a>b">if (a > b) { x }</script><p')))
            .when(key % 6 == 3, F.concat(F.lit("<head>"), title, F.lit('<link rel="x"><base href="https://base.example/b/c?x"><p>'), anchor, F.lit("\t"), written))
            .when(key % 6 == 4, F.concat(F.lit("<noscript>nein</noscript><div><svg><title>Bild</title></svg> "), anchor, F.lit(" "), written))
            .otherwise(F.concat(F.lit("<style>p > b {}</style>&nbsp;&#228;&#xE4;&szlig; "), anchor, F.lit(" "), written, F.lit("&#160;"))))
        # what stands before the page: empty comments, a comment with another end, a title and a script without a head
        before = (F.when(key % 4 == 0, "<!-->").when(key % 4 == 1, "<!---><title>Ohne Kopf</title>\n").when(key % 4 == 2, "<!-- > --!> ")
                  .otherwise("<!doctype html><script>var a = '</head>xy';</script>"))
        return self.table("documents").select(
            key.alias("page_id"), F.concat(F.lit("https://www.host"), _text(key % 13), F.lit(".de/a/b/c.html")).alias("url"),
            F.concat(before, html).alias("html"))

    @cached_property
    def event(self) -> DataFrame:
        return self.table("events").select("event_id", "ts", "user_id", "event_type", "value")

    @cached_property
    def page(self) -> DataFrame:
        return self.table("pages").select("page_id", "url", "html")


# The oracle's wording of the same views.  Fixed values: patterns, word lists and messages in it.
SQL: dict[str, str] = {
    "v_provider": """SELECT c_custkey AS id,
       CONCAT(c_name, CASE c_custkey % 4 WHEN 0 THEN ' GmbH' WHEN 1 THEN ' AG' WHEN 2 THEN ' GmbH & Co. KG' ELSE '' END) AS name,
       n_name AS city,
       CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CONCAT('12 ', CAST(c_custkey AS STRING)) END AS file_number,
       CAST(50 + 10 * (c_custkey % 6) AS INT) AS priority,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'geprueft' WHEN 'MACHINERY' THEN 'beanstandet'
                         WHEN 'HOUSEHOLD' THEN NULL ELSE 'offen' END AS review_status,
       c_acctbal >= 0 AS active
FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "v_job": """SELECT o_orderkey AS id, o_custkey - CASE WHEN o_custkey % 10 = 0 THEN 1 ELSE 0 END AS provider_id,
       CASE o_orderstatus WHEN 'O' THEN 'success' WHEN 'P' THEN 'partial'
                          ELSE CASE WHEN o_orderkey % 7 = 0 THEN 'running' ELSE 'failed' END END AS status,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'Timeout nach 2 Min.' WHEN '2-HIGH' THEN 'Keine Ergebnisse gefunden'
            WHEN '3-MEDIUM' THEN 'duplicate key value violates unique constraint'
            WHEN '5-LOW' THEN NULL ELSE 'Suchmaschinen nicht erreichbar oder blockiert' END AS log_message,
       o_orderdate AS started_at
FROM orders""",
    "v_mix": """SELECT o_orderkey AS id, o_custkey AS provider_id,
       CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderkey // 60 END AS document_id,
       CAST(year(o_orderdate) + 24 AS INT) AS year,
       CAST(2 * min(l_quantity) AS DECIMAL(5,2)) AS renewable_percentage,
       CAST(100 - 2 * min(l_quantity) AS DECIMAL(5,2)) AS fossil_percentage,
       CAST(100 * max(l_discount) AS DECIMAL(5,2)) AS nuclear_percentage,
       CAST(min(l_quantity) AS DECIMAL(5,2)) AS wind_percentage,
       CAST(max(l_quantity) AS DECIMAL(5,2)) AS coal_percentage,
       CAST(min(l_quantity) AS DECIMAL(5,2)) AS hkn_percentage,
       CAST(10 * max(l_quantity) AS DECIMAL(6,2)) AS co2_emission_g_kwh,
       CAST(o_orderkey % 101 AS INT) AS confidence,
       CASE o_orderkey % 4 WHEN 0 THEN 'manual' WHEN 1 THEN 'regex' WHEN 2 THEN 'ocr' ELSE 'gemini_text' END AS extraction_method,
       CASE o_orderkey % 11 WHEN 0 THEN 'unbestaetigt' WHEN 1 THEN 'bestaetigt' ELSE NULL END AS source_status,
       o_orderdate AS created_at
FROM orders JOIN lineitem ON o_orderkey = l_orderkey
GROUP BY o_orderkey, o_custkey, o_orderdate""",
    "v_delivery": """SELECT o_custkey AS provider_id, CAST(year(o_orderdate) + 24 AS INT) AS year,
       CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) AS DECIMAL(15,2)) AS delivered_volume_mwh
FROM orders GROUP BY o_custkey, year(o_orderdate)""",
    "v_cancellation": """SELECT o_custkey AS provider_id, CAST(year(o_orderdate) + 24 AS INT) AS year, n_name AS country,
       CAST(sum(CAST(l_quantity AS DECIMAL(15,2))) * 100 AS DECIMAL(15,2)) AS amount_mwh
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
              JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
GROUP BY o_custkey, year(o_orderdate), n_name""",
    "v_audit": """SELECT DISTINCT k AS provider_id, CAST(year(o_orderdate) + 24 AS INT) AS year,
       CASE k % 4 WHEN 0 THEN 'plausibel' WHEN 1 THEN 'fehlerhaft_hkn' ELSE 'beanstandet' END AS status
FROM (SELECT *, greatest(3, o_custkey - o_custkey % 3) AS k FROM orders)""",
    "v_doc": """SELECT doc_id AS id, doc_id % 97 AS provider_id,
       CASE doc_id % 5 WHEN 0 THEN 'image' WHEN 1 THEN 'manual' ELSE 'pdf' END AS file_type,
       sha256(text) AS file_hash,
       CONCAT('https://www.host', CAST(doc_id % 13 AS STRING), '.de/skz/', source, '.pdf') AS source_url,
       CASE WHEN doc_id % 8 = 0 THEN NULL ELSE CAST(2019 + doc_id % 7 AS INT) END AS reporting_year,
       text
FROM documents""",
    "v_jobdoc": """SELECT o_orderkey AS id, o_custkey AS provider_id,
       o_orderdate + to_seconds(o_orderkey % 180 - 90) AS created_at FROM orders""",
    "v_trusted": """SELECT DISTINCT k AS provider_id, CONCAT('host', CAST(k % 13 AS STRING), '.de') AS domain
FROM (SELECT doc_id % 97 - doc_id % 97 % 2 AS k FROM documents)""",
    "v_token": """SELECT id // 40 AS page, 10 * id + k AS seq, x, (id % 40) * 1.5::DOUBLE + 0.01::DOUBLE * k AS y, text FROM (
  SELECT id, 0 AS k, 3.5::DOUBLE AS x, CASE WHEN id % 50 = 0 THEN 'Stand 2024' WHEN id % 53 = 0 THEN 'AB' ELSE name END AS text FROM v_provider
  UNION ALL SELECT id, 1, 6.0, 'Zweitname' FROM v_provider WHERE id % 11 = 0
  UNION ALL SELECT id, 2, 24.6, CONCAT(' Weg ', CAST(id AS STRING)) FROM v_provider WHERE id % 7 <> 0
  UNION ALL SELECT id, 3, 35.5, right('00000' || CAST(id AS STRING), 5) FROM v_provider
  UNION ALL SELECT id, 4, 39.4, city FROM v_provider)""",
    "v_ledger": """SELECT year AS ledger_id, provider_id * 100 + n_nationkey + 10 AS line_no,
       '  ' || concat_ws(',', nm, CAST(year AS STRING), CAST(delivered_volume_mwh AS STRING), land, CAST(amount_mwh AS STRING), 'x') AS line
FROM (SELECT c.*, n_nationkey, delivered_volume_mwh,
             CASE WHEN c.provider_id % 19 = 0 THEN 'Unbekannt ' || CAST(c.provider_id AS STRING) ELSE upper(name) END AS nm,
             CASE WHEN c.provider_id % 17 = 0 THEN '' ELSE ' ' || c.country END AS land
      FROM v_cancellation c JOIN nation ON n_name = c.country
           JOIN v_delivery d ON d.provider_id = c.provider_id AND d.year = c.year
           JOIN v_provider p ON p.id = c.provider_id)
UNION ALL
SELECT year, provider_id * 100 + n_nationkey + 10 + 1000000000000,
       CASE WHEN provider_id % 23 = 0 THEN concat_ws(',',
            CASE WHEN provider_id % 19 = 0 THEN 'Unbekannt ' || CAST(provider_id AS STRING) ELSE upper(name) END,
            CAST(year AS STRING), CASE WHEN provider_id % 46 = 0 THEN '1e30' WHEN provider_id % 69 = 0 THEN 'viel' ELSE '7.50' END, CASE WHEN provider_id % 17 = 0 THEN '' ELSE ' ' || country END, '1.25')
       ELSE '  ' END
FROM v_cancellation JOIN nation ON n_name = country JOIN v_provider p ON p.id = provider_id
UNION ALL
SELECT DISTINCT year, 1, 'anbieter_name,berichtsjahr,strommenge_mwh,hkn_land,hkn_menge_mwh' FROM v_delivery""",
    # the fields of the ledger, read off its lines
    "v_ledger_row": """SELECT ledger_id, line_no, line, string_split(trim(line), ',') AS f
FROM v_ledger WHERE trim(line) <> ''
QUALIFY row_number() OVER (PARTITION BY ledger_id ORDER BY line_no) > 1""",
    "v_ledger_match": """SELECT r.*, p.provider_id FROM (
  SELECT *, regexp_replace(regexp_replace(lower(f[1]), '\\b(gmbh & co\\.?\\s*kg|gmbh & co\\.?\\s*ohg|gmbh|co\\.?\\s*kg|ag|eg|ug|se)\\b', '', 'g'), '[^a-z0-9äöüß]', '', 'g') AS k
  FROM v_ledger_row WHERE f[1] <> '' AND f[2] <> '' AND f[3] <> '' AND f[4] <> '' AND f[5] <> '' AND f[3] NOT IN ('1e30', 'viel')) r
LEFT JOIN (
  SELECT regexp_replace(regexp_replace(lower(name), '\\b(gmbh & co\\.?\\s*kg|gmbh & co\\.?\\s*ohg|gmbh|co\\.?\\s*kg|ag|eg|ug|se)\\b', '', 'g'), '[^a-z0-9äöüß]', '', 'g') AS k,
         min(id) AS provider_id FROM v_provider GROUP BY 1) p ON p.k = r.k""",
    "v_response": """SELECT id, CASE WHEN id % 6 < 3 THEN '```json' || chr(10) || body || chr(10) || '```' ELSE body END AS raw_response FROM (
  SELECT id, CASE WHEN id % 17 = 0 THEN '{"year": ' ELSE
    '{"is_skz": ' || CASE WHEN id % 13 = 0 THEN 'false' ELSE 'true' END
    || ', "year": ' || year || ', "renewable": ' || renewable_percentage || ', "fossil": ' || fossil_percentage
    || ', "nuclear": ' || nuclear_percentage || ', "wind": ' || wind_percentage || ', "coal": ' || coal_percentage
    || ', "co2": ' || co2_emission_g_kwh
    || CASE WHEN id % 3 = 0 THEN ', "radioactive_waste": 0.0007' ELSE ', "waste": 0.0005, "radioactive_waste": 0.9' END
    || CASE WHEN id % 2 = 0 THEN ', "ee_with_hkn": ' || hkn_percentage ELSE ', "hkn": 7.5, "ee_with_hkn": 1' END
    || CASE WHEN id % 4 = 0 THEN '' ELSE ', "confidence": ' || confidence END
    || CASE id % 5 WHEN 0 THEN ', "hkn_origins": [{"country": "Norwegen", "percentage": 60.5}]'
                   WHEN 1 THEN ', "hkn_origins": "Norwegen"' ELSE ', "hkn_origins": null' END
    || '}' END AS body
  FROM v_mix)""",
    "v_result": """SELECT provider_id, id AS position, CASE id % 7
    WHEN 0 THEN 'https://cdn.example.net/files/' || replace(name, '#', '') || '/Strommix.pdf/1b01?download=true'
    WHEN 1 THEN 'https://duckduckgo.com/l/?uddg=' || replace(replace(own, ':', '%3A'), '/', '%2F') || '&rut=123'
    WHEN 2 THEN 'https://www.bing.com/ck/a?!&&p=5812&u=a1' || replace(to_base64(encode(own)), '=', '') || '&ntb=1'
    WHEN 3 THEN 'https://de.wikipedia.org/wiki/' || host
    WHEN 4 THEN 'https://' || host || '.de/agb/tarif'
    WHEN 5 THEN 'https://www.' || host || '.de/'
    ELSE source_url END AS url, name || ' Stromkennzeichnung' AS query
FROM (SELECT d.id, d.provider_id, d.source_url, p.name, lower(regexp_replace(p.name, '[^A-Za-z0-9]', '', 'g')) AS host,
             'https://www.' || lower(regexp_replace(p.name, '[^A-Za-z0-9]', '', 'g')) || '.de/stromkennzeichnung.pdf' AS own
      FROM v_doc d JOIN v_provider p ON p.id = d.provider_id)""",
    "v_link": """SELECT doc_id // 48 AS page_id, doc_id AS position, 'https://www.host.de/' || CASE doc_id % 8
    WHEN 0 THEN 'stromkennzeichnung-' || n || '.pdf' WHEN 1 THEN 'energiemix-' || n || '.PNG?x=1'
    WHEN 2 THEN 'pdf/bericht-' || n WHEN 3 THEN 'logo-strommix-' || n || '.png'
    WHEN 4 THEN 'kennzeichnung-' || n || '.html' WHEN 5 THEN 'download/' || n || '.pdf?v=2'
    WHEN 6 THEN 'bild-' || n || '.jpeg' ELSE 'nachweis-' || n || '.pdf' END AS href,
  CASE WHEN doc_id % 5 = 0 THEN 'strommix herunterladen' ELSE 'download' END AS text,
  CASE WHEN doc_id % 8 = 5 THEN 'stromkennzeichnung 2024' ELSE '' END AS title,
  CASE WHEN doc_id % 8 = 6 THEN 'energiemix als bild' ELSE '' END AS aria_label,
  CASE WHEN doc_id % 9 = 0 THEN 'energiequelle' ELSE '' END AS alt
FROM (SELECT doc_id, CAST(doc_id // 24 AS STRING) AS n FROM documents)""",
    "v_words": """SELECT id, name, list_filter(list_transform(
    string_split_regex(regexp_replace(regexp_replace(regexp_replace(lower(name),
      '\\b(stromkennzeichnung|energiemix|strommix|energietraeger|energy-mix|strom-mix|kennzeichnung|energiequelle)\\b', '', 'g'),
      '\\bpdf\\b', '', 'g'),
      '\\b(gmbh & co\\.? kg|gmbh & co\\.? ohg|gmbh|co\\.? kg|ag|eg|ug|se|solutions|service|services|energy|energie|strom|gas|versorgung|stadtwerke|stadtwerk|werke|werk|holding|deutschland)\\b', '', 'g'),
      '[\\s,.\\-/&()]+'),
    lambda w: regexp_replace(w, '[^a-z0-9äöüß]', '', 'g')), lambda w: length(w) > 2) AS words
FROM v_provider""",
    # latest rows, by window
    "v_last_job": "SELECT * FROM v_job QUALIFY row_number() OVER (PARTITION BY provider_id ORDER BY id DESC) = 1",
    "v_last_mix": "SELECT * FROM v_mix QUALIFY row_number() OVER (PARTITION BY provider_id ORDER BY id DESC) = 1",
    "v_snapshot": """SELECT p.*, j.status AS latest_job_status, j.log_message AS latest_job_log,
       EXISTS (SELECT 1 FROM v_mix m WHERE m.provider_id = p.id AND m.source_status = 'unbestaetigt') AS has_unverified_source,
       EXISTS (SELECT 1 FROM v_doc d JOIN v_doc d2 ON d2.file_hash = d.file_hash AND d2.provider_id <> d.provider_id
               WHERE d.provider_id = p.id AND d.file_type <> 'manual') AS has_duplicate_doc,
       (SELECT count(*) FROM v_doc d WHERE d.provider_id = p.id) AS document_count,
       m.year AS last_mix_year, m.renewable_percentage AS last_renewable_percentage,
       m.fossil_percentage AS last_fossil_percentage, m.nuclear_percentage AS last_nuclear_percentage,
       m.co2_emission_g_kwh, m.confidence AS last_confidence, m.extraction_method AS last_extraction_method
FROM v_provider p LEFT JOIN v_last_job j ON j.provider_id = p.id LEFT JOIN v_last_mix m ON m.provider_id = p.id""",
    "v_star": """SELECT p.id AS provider_id, p.name AS provider_name, p.file_number, s.delivered_volume_mwh,
       m.id AS mix_id, d.id AS document_id, m.hkn_percentage, m.renewable_percentage, a.status AS audit_status
FROM v_provider p
LEFT JOIN v_delivery s ON p.id = s.provider_id AND s.year = 2021
LEFT JOIN v_doc d ON p.id = d.provider_id AND d.reporting_year = 2021 AND d.file_type = 'pdf'
LEFT JOIN v_mix m ON d.id = m.document_id
LEFT JOIN v_audit a ON p.id = a.provider_id AND a.year = 2021
WHERE p.active""",
    # whole numbers: shares and volumes in hundredths (h, v, i), products in millionths
    "v_recon": """SELECT provider_id, provider_name, file_number, document_id, mix_id, audit_status, h / 100.0 AS hkn, v / 100.0 AS volume, i / 100.0 AS ist_mwh,
       CAST(s AS DOUBLE) / 1000000 AS soll_mwh, CAST(i * 10000 - s AS DOUBLE) / 1000000 AS difference_mwh,
       CASE WHEN s = 0 THEN 0.0 ELSE CAST(sign(i * 10000 - s) * ((2 * abs(i * 10000 - s) * 10000 + s) // (2 * s)) AS DOUBLE) / 100 END AS deviation_percent,
       CASE WHEN v > 0 THEN CAST(sign(i * 10000 - h * v) * ((2 * abs(i * 10000 - h * v) * 100 + v * 100) // (2 * v * 100)) AS DOUBLE) ELSE CAST(-h AS DOUBLE) END / 100 AS mix_point_diff
FROM (SELECT *, h * v AS s FROM (
  SELECT st.provider_id, provider_name, file_number, document_id, mix_id, coalesce(audit_status, 'offen') AS audit_status,
         CAST(coalesce(hkn_percentage, 0) * 100 AS HUGEINT) AS h, CAST(coalesce(delivered_volume_mwh, 0) * 100 AS HUGEINT) AS v,
         CAST(coalesce(t.total, 0) * 100 AS HUGEINT) AS i
  FROM v_star st LEFT JOIN (SELECT provider_id, sum(amount_mwh) AS total FROM v_cancellation
                            WHERE year = 2021 GROUP BY 1) t ON t.provider_id = st.provider_id))""",
}

_NAME = re.compile(r"\bv_[a-z_]+\b")


def with_views(statement: str) -> str:
    """The statement with the definitions of all views it uses, directly or not, in front."""
    needed: list[str] = []

    def add(text: str) -> None:
        for name in dict.fromkeys(_NAME.findall(text)):
            if name in SQL and name not in needed:
                add(SQL[name])
                needed.append(name)

    add(statement)
    heads = [f"{name} AS MATERIALIZED ({SQL[name]})" for name in needed]
    own = re.match(r"(?is)^\s*WITH\s+(RECURSIVE\s+)?", statement)
    if own:
        return f"WITH {own.group(1) or ''}" + ",\n".join([*heads, statement[own.end():]])
    return "WITH " + ",\n".join(heads) + "\n" + statement if heads else statement
