"""Fixed values.

These dictionaries must equal the ones of the original patient pipeline for results to
match (category codes, display labels, fill defaults, cluster descriptions).  They are
kept here verbatim, in their natural order, and fed to the generic operators
(``recode``, ``fill_by_rules``, ``describe_clusters``) as plain arguments.
"""

# --- fixed values: category -> code -------------------------------------------------
TUMOR_TYPE_CODES = {"Lung": 0, "Colorectal": 1, "Breast": 2, "Liver": 3, "Stomach": 4, "Other": 5}
TREATMENT_TYPE_CODES = {"Surgery": 0, "Chemotherapy": 1, "Radiation": 2, "Combined": 3, "Palliative": 4}
CANCER_STAGE_CODES = {"Stage I": 1, "Stage II": 2, "Stage III": 3, "Stage IV": 4}
SMOKING_STATUS_CODES = {"Never": 0, "Former": 1, "Current": 2}
ALCOHOL_USE_CODES = {"None": 0, "Moderate": 1, "Heavy": 2}

# --- fixed values: code -> display label --------------------------------------------
TUMOR_TYPE_LABELS = {0: "Paru-paru", 1: "Kolorektal", 2: "Payudara", 3: "Hati", 4: "Lambung", 5: "Lainnya"}
TREATMENT_TYPE_LABELS = {0: "Operasi", 1: "Kemoterapi", 2: "Radiasi", 3: "Kombinasi", 4: "Paliatif"}
CANCER_STAGE_LABELS = {1: "Stadium I", 2: "Stadium II", 3: "Stadium III", 4: "Stadium IV"}
SMOKING_STATUS_LABELS = {0: "Tidak Pernah", 1: "Mantan Perokok", 2: "Perokok Aktif"}
ALCOHOL_USE_LABELS = {0: "Tidak", 1: "Moderat", 2: "Berat"}
GENDER_LABELS = {0: "Perempuan", 1: "Laki-laki"}

FEATURE_LABELS = {
    "Age": "Usia",
    "TumorSize": "Ukuran Tumor",
    "ChemotherapySessions": "Sesi Kemoterapi",
    "RadiationSessions": "Sesi Radiasi",
    "CancerStage_encoded": "Stadium Kanker",
    "SmokingStatus_encoded": "Status Merokok",
    "AlcoholUse_encoded": "Konsumsi Alkohol",
    "Gender_Male": "Jenis Kelamin (1=Pria)",
    "Metastasis_Yes": "Metastasis (1=Ya)",
    "TumorType_encoded": "Jenis Tumor",
    "SurvivalStatus_Survived": "Status Kelangsungan Hidup",
    "FollowUpMonths": "Bulan Follow-Up",
    "Cluster": "Cluster",
}
METRIC_LABELS = {
    "accuracy": "Accuracy (Akurasi)",
    "precision": "Precision (Presisi)",
    "recall": "Recall (Sensitivitas)",
    "f1": "F1-Score",
    "auc": "AUC-ROC",
}

# --- fixed values: columns of a stored prediction ------------------------------------
PREDICTION_COLUMNS = ["Cluster", "Survival_Probability", "Prediction"]

# --- fixed values: binary indicators (column, positive value) -----------------------
BINARY_INDICATORS = {"Gender": "Male", "Metastasis": "Yes", "SurvivalStatus": "Survived"}

# --- fixed values: rule-table fill (constant, or a statistic of the column) ---------
FILL_RULES = {
    "CancerStage_encoded": 2,
    "TreatmentType_encoded": 3,
    "AlcoholUse_encoded": 1,
    "TumorType_encoded": 0,
    "Age": "median",
    "TumorSize": "median",
    "ChemotherapySessions": "median",
    "RadiationSessions": "median",
    "SmokingStatus_encoded": 1,
    "Gender_Male": 0,
    "Metastasis_Yes": 0,
    "Cluster": 0,
}
# defaults used by the dashboard when a median column is entirely missing
MEDIAN_FALLBACKS = {"Age": 60, "TumorSize": 3.5, "ChemotherapySessions": 6, "RadiationSessions": 10}

# --- fixed values: feature lists ----------------------------------------------------
CLUSTER_FEATURES = [
    "Age", "TumorSize", "ChemotherapySessions", "RadiationSessions", "CancerStage_encoded",
    "SmokingStatus_encoded", "AlcoholUse_encoded", "Gender_Male", "Metastasis_Yes",
]
PROFILE_FEATURES = [
    "Age", "TumorSize", "ChemotherapySessions", "RadiationSessions", "CancerStage_encoded",
    "SurvivalStatus_Survived",
]

# --- fixed values: cluster descriptions, probability bands, labels ------------------
CLUSTER_DESCRIPTIONS = {
    0: "Young Survivors - Pasien yang lebih muda dengan stadium awal dan tingkat kelangsungan hidup tinggi",
    1: "Mid-stage Patients - Pasien dengan stadium menengah dan pengobatan kombinasi",
    2: "Advanced Cases - Kasus lanjut dengan metastasis dan prognosis yang kurang baik",
}
PROBABILITY_BAND_EDGES = [0, 25, 50, 75, 100]
PROBABILITY_BAND_NAMES = ["red", "orange", "yellow", "lightgreen"]
POSITIVE_LABEL = "Survived"
NEGATIVE_LABEL = "Deceased"
# risk-factor rules of the scoring form: (column, operator, threshold) -> safe when true
RISK_RULES = [("CancerStage_encoded", "<", 3), ("Metastasis_Yes", "==", 0), ("TumorSize", "<", 5)]
