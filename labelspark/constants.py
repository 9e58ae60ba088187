"""Fixed values of the domain: word lists, lookup tables, thresholds and formats."""

# --- Fixed values: legal forms and generic words in supplier names -----------------------------
LEGAL_FORMS = [
    r"gmbh & co\.?\s*kg",
    r"gmbh & co\.?\s*ohg",
    r"gmbh",
    r"co\.?\s*kg",
    r"ag",
    r"eg",
    r"ug",
    r"se",
]

NAME_STOP_TERMS = [
    r"gmbh & co\.? kg",
    r"gmbh & co\.? ohg",
    r"gmbh",
    r"co\.? kg",
    r"ag",
    r"eg",
    r"ug",
    r"se",
    r"solutions",
    r"service",
    r"services",
    r"energy",
    r"energie",
    r"strom",
    r"gas",
    r"versorgung",
    r"stadtwerke",
    r"stadtwerk",
    r"werke",
    r"werk",
    r"holding",
    r"deutschland",
]

# --- Fixed values: words that mark a link as pointing to an electricity label ------------------
LABEL_KEYWORDS = [
    "stromkennzeichnung",
    "energiemix",
    "strommix",
    "energietraeger",
    "energy-mix",
    "strom-mix",
    "kennzeichnung",
    "energiequelle",
]

# --- Fixed values: hosts never accepted as a source -------------------------------------------
BLACKLISTED_DOMAINS = [
    "bdew.de",
    "wikipedia.org",
    "gesetze-im-internet.de",
    "bundesnetzagentur.de",
    "umweltbundesamt.de",
    "energieverbraucherportal.de",
    "duckduckgo.com",
    "bing.com",
    "apps.apple.com",
    "play.google.com",
    "northdata.de",
    "creditreform.de",
    "insolvenz-radar.de",
    "provenexpert.com",
    "firmenpresse.de",
    "fair-news.de",
    "linkedin.com",
    "xing.com",
    "facebook.com",
    "instagram.com",
    "youtube.com",
]

# --- Fixed values: words that make a search result less relevant -------------------------------
IRRELEVANT_URL_WORDS = [
    "leitfaden",
    "anleitung",
    "guide",
    "kontakt",
    "netznutzer",
    "mscons",
    "invoic",
    "remadv",
    "preisblatt",
    "tarif",
    "agb",
    "datenschutz",
    "impressum",
]

# --- Fixed values: link scores ------------------------------------------------------------------
LINK_SCORES = {"pdf": 50, "image": 30, "keyword_href": 30, "keyword_text": 20, "decoration": -100}
DECORATION_WORDS = ["logo", "icon", "banner"]
SEARCH_SCORES = {"pdf": 100, "host": 400, "path": 150, "keyword": 30, "irrelevant": -100}

# --- Fixed values: supplier-name word lists for data hygiene ------------------------------------
INVALID_NAME_WORDS = [
    "verordnung",
    "gesetz",
    "recht",
    "paragraph",
    "eigenbetrieb",
    "anstalts",
    "verwaltung",
    "c/o",
    "verbandsgemeindeverwaltung",
    "ministerium",
    "behörde",
    "landesrecht",
]
TEST_DATA_WORDS = ["muster", "test", "example", "demo", "sample", "beispiel", "platzhalter"]

# --- Fixed values: priority tiers by brand ------------------------------------------------------
BRAND_TIERS = {
    100: [
        "E.ON", "RWE", "EnBW", "Vattenfall", "Stadtwerke München", "Stadtwerke Hamburg", "Mainova",
        "N-ERGIE", "EWE", "WEMAG",
    ],
    90: [
        "Stadtwerke Berlin", "Stadtwerke Düsseldorf", "Stadtwerke Köln", "Stadtwerke Frankfurt",
        "Stadtwerke Stuttgart", "Stadtwerke Leipzig", "Stadtwerke Dresden", "Stadtwerke Hannover",
        "Stadtwerke Bremen", "Stadtwerke Nürnberg", "Stadtwerke Dortmund", "Stadtwerke Essen",
        "Stadtwerke Duisburg", "SWB", "Rheinenergie", "MVV Energie", "Pfalzwerke", "EWR", "Thüga",
    ],
    80: [
        "Stadtwerke Augsburg", "Stadtwerke Bielefeld", "Stadtwerke Bochum", "Stadtwerke Bonn",
        "Stadtwerke Braunschweig", "Stadtwerke Chemnitz", "Stadtwerke Erfurt", "Stadtwerke Freiburg",
        "Stadtwerke Karlsruhe", "Stadtwerke Kiel", "Stadtwerke Lübeck", "Stadtwerke Magdeburg",
        "Stadtwerke Mainz", "Stadtwerke Mannheim", "Stadtwerke Münster", "Stadtwerke Rostock",
        "Stadtwerke Wiesbaden", "Stadtwerke Wuppertal",
    ],
    70: [
        "Stadtwerke Aachen", "Stadtwerke Flensburg", "Stadtwerke Göttingen", "Stadtwerke Heidelberg",
        "Stadtwerke Ingolstadt", "Stadtwerke Jena", "Stadtwerke Kassel", "Stadtwerke Koblenz",
        "Stadtwerke Konstanz", "Stadtwerke Lüneburg", "Stadtwerke Oldenburg", "Stadtwerke Osnabrück",
        "Stadtwerke Pforzheim", "Stadtwerke Potsdam", "Stadtwerke Regensburg", "Stadtwerke Schwerin",
        "Stadtwerke Trier", "Stadtwerke Ulm",
    ],
}

# --- Fixed values: failure categories, in the order in which they are tried ---------------------
FAILURE_RULES = [
    ("bereinigt", ["bereinigt"]),
    ("abgebrochen", ["abgebrochen"]),
    ("suchmaschine_blockiert", ["blockiert", "suchmaschinen nicht erreichbar"]),
    ("kein_treffer", ["keine ergebnisse", "keine zum anbieter passenden", "passenden suchergebnisse"]),
    ("timeout", ["timeout", "timed out"]),
    ("duplikat", ["duplicate key", "unique constraint", "duplikat"]),
]
FAILURE_DEFAULT = "sonstige"
FAILURE_LABELS = {
    "suchmaschine_blockiert": "Suchmaschine blockiert",
    "kein_treffer": "Kein passender Treffer",
    "timeout": "Timeout",
    "duplikat": "Duplikat-Konflikt",
    "abgebrochen": "Abgebrochen",
    "bereinigt": "Bereinigt (Fremd-Dokument)",
    "sonstige": "Sonstige Fehler",
}
FAILURE_HINTS = {
    "suchmaschine_blockiert": "Vorübergehend — später erneut scrapen",
    "kein_treffer": "Meist manuelle URL-Pflege nötig (Details → URL eintragen)",
    "timeout": "Retry-Kandidat — Seite war zu langsam",
    "duplikat": "Dokument existiert bereits — Archiv prüfen",
    "abgebrochen": "Batch wurde gestoppt — einfach erneut scrapen",
    "bereinigt": "Falsches Dokument wurde entfernt — erneut scrapen",
    "sonstige": "Log-Meldung im Detail prüfen",
}

# --- Fixed values: labels of the exports and the audit trail ------------------------------------
JOB_STATUS_LABELS = {
    "success": "Erfolgreich",
    "failed": "Fehlgeschlagen",
    "running": "Laufend",
    "partial": "Teilweise",
    "pending": "Wartend",
}
JOB_STATUS_DEFAULT = "Nie gescrapt"
REVIEW_LABELS = {"offen": "Offen", "geprueft": "Geprüft", "beanstandet": "Beanstandet"}
REVIEW_DEFAULT = "offen"
CSV_HEADER = [
    "Anbieter-ID", "Anbieter-Name", "Stadt", "PLZ", "Aktenzeichen", "Prioritaet", "Aktiv", "Jahr",
    "Erneuerbar %", "Fossil %", "Nuklear %", "CO2 (g/kWh)", "Konfidenz %", "Extraktionsmethode",
    "Letzter Job-Status", "Prüfstatus", "Dokumente",
]
AUDIT_FIELDS = {
    "name": "Name",
    "url": "URL",
    "skz_url": "SKZ-URL",
    "address": "Adresse",
    "zip": "PLZ",
    "city": "Stadt",
    "file_number": "Aktenzeichen",
    "priority": "Priorität",
    "review_status": "Prüfstatus",
}

# --- Fixed values: plausibility of declared mixes -----------------------------------------------
EMISSION_FACTORS = {
    "solar": 43, "wind": 12, "hydro": 21, "biomass": 210, "other_renewable": 100,
    "coal": 1000, "natural_gas": 480, "other_fossil": 750, "nuclear": 12,
}
RENEWABLE_PARTS = ["solar", "wind", "hydro", "biomass", "other_renewable"]
FOSSIL_PARTS = ["coal", "natural_gas", "other_fossil"]
RENEWABLE_DEFAULT_FACTOR = 50
FOSSIL_DEFAULT_FACTOR = 700
SUM_TOLERANCE_ERROR = 2.0
SUM_TOLERANCE_WARNING = 0.5
PART_EPSILON = 0.5
CO2_ABS_TOLERANCE = 60
CO2_REL_TOLERANCE = 0.35
NUCLEAR_PHASEOUT_YEAR = 2023

# --- Fixed values: national mix per year (renewable, fossil, nuclear, g CO2/kWh) ----------------
NATIONAL_MIX = {
    2020: (45.5, 40.5, 6.1, 366),
    2021: (42.0, 44.3, 6.4, 420),
    2022: (44.1, 42.9, 6.4, 434),
    2023: (51.8, 39.5, 1.5, 380),
}
NATIONAL_FALLBACK_YEAR = 2023

# --- Fixed values: accepted enumerations and lengths --------------------------------------------
EXTRACTION_METHODS = ["gemini_vision", "gemini_text", "regex", "manual", "ocr"]
MIX_TYPES = ["gesamtmix", "unternehmensmix", "tarifmix", "unbekannt"]
REVIEW_STATUSES = ["offen", "geprueft", "beanstandet"]
MIX_SHARES = [
    "renewable_percentage", "fossil_percentage", "nuclear_percentage", "wind_percentage",
    "solar_percentage", "biomass_percentage", "hydro_percentage", "other_renewable_percentage",
    "eeg_funded_percentage", "hkn_percentage", "mieterstrom_percentage", "coal_percentage",
    "natural_gas_percentage", "other_fossil_percentage", "eeg_percentage",
]

# --- Fixed values: headings and keywords of printed labels --------------------------------------
SECTION_STARTS = [
    ("gesamtenergieträgermix", "gesamtmix"),
    ("gesamtenergiemix", "gesamtmix"),
    ("gesamtstrommix", "gesamtmix"),
    ("unternehmensmix", "unternehmensmix"),
    ("unternehmensverkaufsmix", "unternehmensmix"),
    ("strommix des unternehmens", "gesamtmix"),
    ("energieträgermix des unternehmens", "gesamtmix"),
    ("stromkennzeichnung des unternehmens", "gesamtmix"),
]
SECTION_STOPS = [
    "bundesmix deutschland",
    "bundesmix",
    "strommix deutschland",
    "deutscher strommix",
    "nationaler strommix",
    "verbleibender energieträgermix",
]
SECTION_LENGTH = 2000
LABEL_YEAR_PATTERN = r"(?:jahr|kennzeichnung|mix|lieferung|zeitraum)\s*(20[0-9]{2})"  # of lower-case text
# share values, in the order in which they claim numbers
SHARE_KEYWORDS = {
    "renewable": [
        "erneuerbare energien", "erneuerbare energieträger", "regenerative energien",
        "regenerative energieträger", "ee-anteil", "ökostrom", "grüner strom", "mieterstrom (gefördert)",
    ],
    "nuclear": ["kernenergie", "kernkraft", "atomenergie", "atomkraft", "nuklear"],
    "fossil": ["fossile energieträger", "fossile energien", "sonstige fossile", "konventionelle energien"],
    "wind": ["windenergie", "windkraft"],
    "solar": ["solarenergie", "photovoltaik", "sonnenenergie"],
    "biomass": ["biomasse", "biogas", "bioenergie"],
    "hydro": ["wasserkraft", "lauf- und speicherwasser"],
    "coal": ["kohle", "steinkohle", "braunkohle"],
    "natural_gas": ["erdgas", "gasförmige brennstoffe"],
}
# every keyword of a main share contains one of these
MAIN_SHARE_HINTS = ["energie", "kraft", "strom", "nuklear", "anteil", "fossile"]
# values outside the shared claims: (unit, keywords), tried in order until one is non-zero
CO2_ATTEMPTS = [
    ("g/kwh", ["co2-emissionen", "co₂-emissionen", "kohlendioxid", "co2", "co₂", "treibhausgasemissionen"]),
    ("g / kwh", ["co2-emissionen", "co₂-emissionen", "kohlendioxid"]),
]
WASTE_ATTEMPTS = [
    ("mg/kwh", ["radioaktiver abfall", "radioaktive abfälle", "atommüll", "nuklearabfall"]),
    ("mg / kwh", ["radioaktiver abfall", "radioaktive abfälle"]),
]
EEG_ATTEMPTS = [("%", ["eeg-umlage", "eeg-anteil", "nach eeg gefördert", "erneuerbare energien, gefördert"])]
FORWARD_REACH = 100
BACKWARD_REACH = 20

# --- Fixed values: job handling -----------------------------------------------------------------
STALE_JOB_SECONDS = 120
STALE_JOB_MESSAGE = "Timeout nach 2 Min."
ABORT_SUFFIX = " | Abgebrochen (Batch-Start)"
MAX_FILE_BYTES = 20 * 1024 * 1024
PROXIMITY_SECONDS = 60

# --- Fixed values: column bands of the printed supplier list ------------------------------------
TOKEN_BANDS = {"name": (3.0, 10.0), "address": (24.0, 30.0), "zip": (35.0, 38.0), "city": (39.0, 48.0)}
TOKEN_NOISE = ["Stand", "Liste der"]
