import base64

from labelspark.functions import labels, names, numbers, urls


def test_match_key(values):
    got = values(names.match_key, ["AggerEnergie GmbH", "Adolf Roth GmbH & Co. KG", "Stadtwerke Leipzig AG", "AGentur", "büeg"], "n string")
    # only ASCII letters count as word characters, so a form behind an umlaut goes too
    assert got == ["aggerenergie", "adolfroth", "stadtwerkeleipzig", "agentur", "bü"]


def test_search_name(values):
    got = values(names.search_name, ["Adolf Roth GmbH & Co. KG", "AggerEnergie GmbH", "1KOMMA5° Services GmbH"], "n string")
    assert got[1:] == ["AggerEnergie", "1KOMMA5 Services"]
    assert got[0] == "Adolf Roth"


def test_brand_words(values):
    got = values(names.brand_words, ["Adolf Roth GmbH & Co. KG Stromkennzeichnung", "Albstadtwerke GmbH", "24/7 Strom GmbH",
                                     "Stadtwerke Bad-Aibling (SWB)"], "n string")
    assert got == [["adolf", "roth"], ["albstadtwerke"], [], ["bad", "aibling", "swb"]]


def test_slug(values):
    assert values(names.slug, ["Süd-Öl Straße & Co.", "ÄÖÜ"], "n string") == ["sued-oel-strasse-co", "aeoeue"]


def test_failure_category(values):
    cases = {
        "Suchmaschinen nicht erreichbar oder blockiert (DuckDuckGo + Bing ohne Ergebnisse)": "suchmaschine_blockiert",
        "Keine Ergebnisse gefunden": "kein_treffer",
        "Keine zum Anbieter passenden Suchergebnisse (nur fremde/generische Treffer)": "kein_treffer",
        "Timeout nach 2 Min.": "timeout",
        'duplicate key value violates unique constraint "documents_file_hash_key"': "duplikat",
        "Job gestartet | Abgebrochen (Batch-Start)": "abgebrochen",
        "Bereinigt: Dokument stammte von fremdem Anbieter (https://x.de)": "bereinigt",
        "net::ERR_NAME_NOT_RESOLVED at https://x.de": "sonstige",
        None: "sonstige",
    }
    assert values(labels.failure_category, list(cases), "m string") == list(cases.values())


def test_source_matches(values):
    cases = [
        ("https://www.werraenergie.de/strommix.pdf", "Werraenergie GmbH", True),
        ("https://cdn.hubspot.net/hubfs/ROTH%20Energie/skz.pdf", "Adolf Roth GmbH & Co. KG", True),
        ("https://www.rwe.com/skz-2024.pdf", "Arndt Solarenergie UG", False),
        ("https://www.suec.de/skz.pdf", "24/7 Strom GmbH", None),
        ("kein-url", "Werraenergie GmbH", None),
        ("https://cdn.net/100%/werraenergie", "Werraenergie GmbH", None),  # malformed escape
        ("https://cdn.net/a b/Werraenergie.pdf", "Werraenergie GmbH", True),  # raw space
    ]
    assert values(urls.source_matches, [c[:2] for c in cases], "u string, n string") == [c[2] for c in cases]


def test_decode_redirect(values):
    def bing(url, safe=True):
        packed = base64.urlsafe_b64encode(url.encode()).decode().rstrip("=")
        return f"https://www.bing.com/ck/a?!&&p=5812&u=a1{packed}&ntb=1"

    target = "https://www.aggerenergie.de/fileadmin/60_service/6.2/2024.pdf"
    cases = {
        "https://www.bing.com/ck/a?!&&p=5812&u=a1aHR0cHM6Ly93d3cuYWdnZXJlbmVyZ2llLmRlLw&ntb=1": "https://www.aggerenergie.de/",
        "https://duckduckgo.com/l/?uddg=https%3A%2F%2Fwww.aggerenergie.de%2Ffileadmin%2F60_service%2F6.2%2F2024.pdf&rut=123": target,
        "https://www.aggerenergie.de/file.pdf": "https://www.aggerenergie.de/file.pdf",
        bing("https://x.de/ä?>>"): "https://x.de/ä?>>",
        bing("ftp://x.de"): bing("ftp://x.de"),
        "https://www.bing.com/ck/a?u=a1%%%": "https://www.bing.com/ck/a?u=a1%%%",
    }
    assert values(urls.decode_redirect, list(cases), "u string") == list(cases.values())


def test_domain_and_file_name(values):
    assert values(urls.domain, ["https://www.Host.DE:8080/x", "http://a.b.de?x=1", "nix", None], "u string") == ["host.de", "a.b.de", None, None]
    got = values(urls.file_name, ["https://x.de/a/Strom%20mix+1.pdf?v=2", "https://x.de/a/", None], "u string")
    assert got == ["Strom mix+1.pdf", "document.pdf", "document.pdf"]


def test_numbers(values):
    assert values(numbers.leading_number, ["12abc", " -3.5 MWh", "abc", ".5", ""], "t string") == [12.0, -3.5, None, 0.5, None]
    assert values(numbers.leading_integer, ["2021.9", "x", "007"], "t string") == [2021, None, 7]
    assert values(lambda c: numbers.round_half_up(c, 2), [1.005, -0.125, 2.345], "x double") == [1.0, -0.12, 2.35]
    assert values(lambda c: numbers.round_half_away(c, 2), [-0.125, 0.125], "x double") == [-0.13, 0.13]
    assert values(lambda c: numbers.plain_number(c.cast("decimal(6,2)")), ["40.00", "60.50", "0.07", "100"], "x string") == ["40", "60.5", "0.07", "100"]
