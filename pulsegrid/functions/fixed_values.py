"""Fixed values.

Everything in this file has to equal the published clinical code lists, cut
points and time spans for results to be right. The values are plain data: no
logic lives here.
"""

# Measurement signals, in output column order.
SIGNALS = [
    "bilirubin", "creatinine", "dbp", "heart_rate", "lactate", "map",
    "platelets", "resp_rate", "sbp", "spo2", "temperature", "wbc",
]

# Statistics per signal, in output column order.
STATS = ["mean", "stddev", "min", "max", "last", "slope"]

# (signal, recording system, item codes)
SIGNAL_CODES = [
    ("heart_rate", "carevue", [211]),
    ("heart_rate", "metavision", [220045]),
    ("sbp", "carevue", [51, 442, 455, 6701]),
    ("sbp", "metavision", [220050, 220179, 225309, 227243]),
    ("dbp", "carevue", [8368, 8440, 8441, 8503, 8504, 8506]),
    ("dbp", "metavision", [220051, 220180, 225310, 227242]),
    ("map", "carevue", [52, 456]),
    ("map", "metavision", [220052, 220181]),
    ("resp_rate", "carevue", [615, 618]),
    ("resp_rate", "metavision", [220210, 224690]),
    ("temperature", "carevue", [676, 677, 678, 679]),
    ("temperature", "metavision", [223761, 223762]),
    ("spo2", "carevue", [646]),
    ("spo2", "metavision", [220277]),
    ("lactate", "labevents", [50813]),
    ("wbc", "labevents", [51300, 51301]),
    ("creatinine", "labevents", [50912]),
    ("bilirubin", "labevents", [50885]),
    ("platelets", "labevents", [51265]),
]

# Item codes used only by the hourly score: (role, item codes).
SCORE_CHART_CODES = [
    ("spo2", [646, 220277]),
    ("map", [52, 456, 220052, 220181]),
    ("fio2", [189, 190, 191, 3420, 3422, 2981, 223835, 227009, 227010]),
    ("coma_total", [198]),
    ("coma_part", [220739, 223900, 223901]),
]
SCORE_LAB_CODES = [
    ("pao2", [50821]),
    ("platelets", [51265]),
    ("bilirubin", [50885]),
    ("creatinine", [50912]),
]
PRESSOR_INTERVAL_CODES = [221906, 221289, 221662, 221653, 222315, 221749]
PRESSOR_POINT_CODES = [
    30120, 30047, 30044, 30119, 30309, 30043, 30307, 30042, 30306, 30051,
]
COMA_PARTS = 3

# Codes recorded in degrees Fahrenheit.
FAHRENHEIT_CODES = [678, 679, 223761]

# (signal, lowest plausible value, highest plausible value), both inclusive.
PLAUSIBLE_RANGES = [
    ("heart_rate", 20.0, 300.0),
    ("sbp", 40.0, 300.0),
    ("dbp", 10.0, 200.0),
    ("map", 20.0, 200.0),
    ("resp_rate", 4.0, 70.0),
    ("temperature", 25.0, 45.0),
    ("spo2", 50.0, 100.0),
    ("lactate", 0.1, 30.0),
    ("wbc", 0.1, 500.0),
    ("creatinine", 0.1, 30.0),
    ("bilirubin", 0.1, 80.0),
    ("platelets", 1.0, 2000.0),
]

# Drug name fragments, lower case.
DRUG_WORDS = [
    "vancomycin", "piperacillin", "meropenem", "cefazolin", "ceftriaxone",
    "ciprofloxacin", "levofloxacin", "metronidazole", "ampicillin",
    "gentamicin", "tobramycin", "amoxicillin", "azithromycin", "clindamycin",
    "linezolid", "daptomycin", "cefepime", "imipenem", "trimethoprim",
    "sulfameth", "fluconazole", "micafungin", "caspofungin", "nafcillin",
    "oxacillin", "penicillin", "erythromycin", "tetracycline", "doxycycline",
    "rifampin", "colistin", "polymyxin", "cephalexin", "cefpodoxime",
]

# Administration routes that count as systemic, upper case.
SYSTEMIC_ROUTES = ["IV", "IV DRIP", "IVPB", "PO", "PO/NG", "NG", "PB", "SL", "ORAL"]

# Specimen word of a culture that counts.
CULTURE_WORDS = ["blood"]

# Cut points: (threshold, value) tried from the top, then the value below all.
SPO2_RATIO_BANDS = ([(97, 400.0), (95, 300.0), (90, 200.0), (80, 100.0)], 50.0)   # >=
RESPIRATORY_BANDS = ([(400, 0), (300, 1), (200, 2), (100, 3)], 4)                 # >
PLATELET_BANDS = ([(150, 0), (100, 1), (50, 2), (20, 3)], 4)                      # >
BILIRUBIN_BANDS = ([(1.2, 0), (2.0, 1), (6.0, 2), (12.0, 3)], 4)                  # <
CREATININE_BANDS = ([(1.2, 0), (2.0, 1), (3.5, 2), (5.0, 3)], 4)                  # <
COMA_BANDS = ([(15, 0), (13, 1), (10, 2), (6, 3)], 4)                             # >=
PRESSURE_CUT = 70
PRESSOR_SCORE = 2

# Time spans.
WINDOW_WIDTH = "1 hour"
WINDOW_SLIDE = "30 minutes"
WATERMARK_DELAY = "1 hour"
HORIZON_HOURS = [6, 12, 24]
FIRST_HORIZON_HOURS = 6
PAIR_FORWARD_HOURS = 24
PAIR_BACK_HOURS = 72
BASELINE_BACK_HOURS = 48
RISE_BACK_HOURS = 48
RISE_AHEAD_HOURS = 24
RISE_POINTS = 2.0
INTERVAL_GRACE_HOURS = 6

# Training and reporting constants.
FOLDS = 5
SEED = 42
SEQUENCE_STEPS = 300
SD_FLOOR = 1e-6
ALERT_THRESHOLD = 0.30
SPECIFICITIES = [0.90, 0.95]
BOOTSTRAP_DRAWS = 1000
PREVALENCE_RANGE = (0.05, 0.40)
TREE_STATS = ["mean", "min", "max", "last"]
NOISY_SUFFIXES = ["_stddev", "_slope"]
HOUR_BIN_CAP = 48

# (signal, lowest, highest) expected share of fresh windows, in percent.
FRESH_RANGES = [
    ("heart_rate", 85.0, 95.0), ("dbp", 85.0, 95.0), ("sbp", 85.0, 95.0),
    ("resp_rate", 85.0, 95.0), ("spo2", 85.0, 95.0), ("map", 85.0, 95.0),
    ("temperature", 20.0, 40.0),
    ("bilirubin", 5.0, 12.0), ("creatinine", 5.0, 12.0),
    ("lactate", 5.0, 12.0), ("platelets", 5.0, 12.0), ("wbc", 5.0, 12.0),
]

TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
