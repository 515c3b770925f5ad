"""Small dimensions of the listing business, as literals: districts, fallback rents, points of interest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Name, appeal, tension, vacancy risk, latitude, longitude, rents furnished and bare for T1, T2, T3.
DISTRICTS = [
    ("Centre-Ville", 85.0, 0.85, "faible", 47.2378, 6.0241, 430.0, 350.0, 550.0, 450.0, 700.0, 580.0),
    ("Boucle", 85.0, 0.85, "faible", 47.2365, 6.0255, 430.0, 350.0, 550.0, 450.0, 700.0, 580.0),
    ("Battant", 80.0, 0.80, "faible", 47.2410, 6.0180, 410.0, 340.0, 520.0, 430.0, 670.0, 560.0),
    ("Rivotte", 75.0, 0.70, "faible", 47.2340, 6.0330, 400.0, 330.0, 520.0, 430.0, 660.0, 550.0),
    ("Chablais", 70.0, 0.70, "moyen", 47.2350, 6.0310, 380.0, 310.0, 480.0, 400.0, 620.0, 520.0),
    ("Chaprais Cras", 75.0, 0.75, "faible", 47.2480, 6.0300, 400.0, 330.0, 500.0, 420.0, 640.0, 540.0),
    ("Grette - Butte", 55.0, 0.55, "moyen", 47.2440, 6.0120, 350.0, 290.0, 440.0, 370.0, 560.0, 480.0),
    ("Bregille - Prés de Vaux", 60.0, 0.55, "moyen", 47.2380, 6.0450, 360.0, 300.0, 460.0, 380.0, 580.0, 490.0),
    ("Montrapon - Fontaine Ecu - Montboucons - Montjoux", 65.0, 0.70, "faible", 47.2380, 6.0080, 390.0, 320.0, 480.0, 400.0, 610.0, 520.0),
    ("Rosemont - Saint-Ferjeux", 60.0, 0.60, "moyen", 47.2430, 6.0050, 360.0, 300.0, 460.0, 380.0, 580.0, 490.0),
    ("Palente - Orchamps - Saragosse - Vaîtes", 55.0, 0.55, "moyen", 47.2530, 6.0400, 340.0, 280.0, 430.0, 360.0, 550.0, 470.0),
    ("Saint-Claude - Torcols - Chailluz", 55.0, 0.55, "moyen", 47.2600, 6.0250, 340.0, 280.0, 430.0, 360.0, 550.0, 470.0),
    ("Velotte", 50.0, 0.45, "moyen", 47.2300, 5.9950, 330.0, 270.0, 420.0, 350.0, 530.0, 460.0),
    ("Clairs-Soleils - Vareilles", 40.0, 0.45, "eleve", 47.2450, 6.0550, 310.0, 260.0, 380.0, 320.0, 490.0, 420.0),
    ("Planoise - Châteaufarine", 40.0, 0.50, "eleve", 47.2200, 6.0000, 320.0, 270.0, 400.0, 330.0, 520.0, 440.0),
]
# Latitude and longitude of points of interest.
POINTS = {
    "tram": [
        (47.2470, 6.0220), (47.2440, 6.0200), (47.2410, 6.0190), (47.2378, 6.0241), (47.2350, 6.0270), (47.2330, 6.0310), (47.2300, 6.0290), (47.2270, 6.0340),
        (47.2500, 6.0150), (47.2530, 6.0050), (47.2410, 6.0280), (47.2390, 6.0350), (47.2340, 6.0200), (47.2480, 6.0300), (47.2320, 6.0380),
    ],
    "shops": [(47.2378, 6.0241), (47.2400, 6.0200), (47.2410, 6.0180), (47.2340, 6.0270), (47.2460, 6.0220)],
    "campus": [(47.2470, 6.0140), (47.2530, 6.0060), (47.2400, 6.0270), (47.2380, 6.0300)],
    "station": [(47.2470, 6.0220), (47.2760, 5.9550)],
}


def districts(spark: SparkSession) -> DataFrame:
    """15 rows: position, name, attributes, centre and fallback rents."""
    schema = "pos int, district string, appeal double, tension double, risk string, lat double, lon double, f1 double, u1 double, f2 double, u2 double, f3 double, u3 double"
    return spark.createDataFrame([(i, *d) for i, d in enumerate(DISTRICTS)], schema)


def fallback_rents(spark: SparkSession) -> DataFrame:
    """district, kind (T1 to T3), furnished, rent: 90 rows."""
    rows = [(i, d[0], f"T{t}", furnished, d[6 + 2 * (t - 1) + (0 if furnished else 1)]) for i, d in enumerate(DISTRICTS) for t in (1, 2, 3) for furnished in (True, False)]
    return spark.createDataFrame(rows, "pos int, district string, kind string, furnished boolean, fallback double")
