"""Fixed values of the document model.

Everything here is a value that results depend on (formats, unit factors, key
names, rename tables).  Logic lives elsewhere.
"""

from __future__ import annotations

# -- Fixed values: text formats ------------------------------------------------
TIMESTAMP_PATTERN = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$"
UID_PATTERN = r"^[0-9a-fA-F_]{33,}$"
CURIE_PATTERN = r"^[a-z][a-z0-9_]*:[^\s:]+$"
SEMVER_PATTERN = r"^(\d+)\.(\d+)\.(\d+)$"

# -- Fixed values: document keys -----------------------------------------------
HEADER_KEY = "document_class"
CLASS_NAME_KEYS = ("class_name", "classname", "_class_name", "_classname")
CLASS_VERSION_KEYS = ("class_version", "_class_version")
SUPERCLASS_KEYS = ("superclasses", "_superclasses")
DEPENDS_ON_KEYS = ("depends_on", "_depends_on")
DEPENDENCY_NAME_KEYS = ("name", "_name")
DEPENDENCY_ID_KEYS = ("document_id", "value", "id", "_document_id", "_value", "_id")
FILE_KEYS = ("file", "_file", "files")
BASE_CLASS = "base"
BASE_FIELDS = ("id", "session_id", "name", "datestamp")

# -- Fixed values: schema set names --------------------------------------------
CURRENT_SCHEMA_VERSION = "V_delta"
LEGACY_SCHEMA_VERSIONS = ("did_v1",)

# -- Fixed values: field types ---------------------------------------------------
UID_TYPE = "did_uid"
TEXT_TYPES = ("char", "string")
NUMBER_TYPES = ("integer", "double")

# -- Fixed values: canonical sub-field of each quantity type ---------------------
CANONICAL_FIELD = {
    "duration": "seconds",
    "volume": "liters",
    "mass": "grams",
    "length": "meters",
    "voltage": "volts",
    "current": "amperes",
    "frequency": "hertz",
}
CONCENTRATION_FIELDS = ("molar", "grams_per_liter", "mass_fraction", "volume_fraction")

# -- Fixed values: units as (dimension, unit, power of ten, multiplier, approximate)
UNITS = (
    ("duration", "nanosecond", -9, 1, False),
    ("duration", "microsecond", -6, 1, False),
    ("duration", "millisecond", -3, 1, False),
    ("duration", "second", 0, 1, False),
    ("duration", "minute", 0, 60, False),
    ("duration", "hour", 0, 3600, False),
    ("duration", "day", 0, 86400, False),
    ("duration", "week", 0, 604800, False),
    ("duration", "month", 0, 2592000, True),
    ("duration", "year", 0, 31536000, True),
    ("volume", "nanoliter", -9, 1, False),
    ("volume", "microliter", -6, 1, False),
    ("volume", "milliliter", -3, 1, False),
    ("volume", "liter", 0, 1, False),
    ("volume", "kiloliter", 3, 1, False),
    ("mass", "nanogram", -9, 1, False),
    ("mass", "microgram", -6, 1, False),
    ("mass", "milligram", -3, 1, False),
    ("mass", "gram", 0, 1, False),
    ("mass", "kilogram", 3, 1, False),
    ("length", "nanometer", -9, 1, False),
    ("length", "micrometer", -6, 1, False),
    ("length", "millimeter", -3, 1, False),
    ("length", "centimeter", -2, 1, False),
    ("length", "meter", 0, 1, False),
    ("length", "kilometer", 3, 1, False),
    ("voltage", "nanovolt", -9, 1, False),
    ("voltage", "microvolt", -6, 1, False),
    ("voltage", "millivolt", -3, 1, False),
    ("voltage", "volt", 0, 1, False),
    ("current", "nanoampere", -9, 1, False),
    ("current", "microampere", -6, 1, False),
    ("current", "milliampere", -3, 1, False),
    ("current", "ampere", 0, 1, False),
    ("frequency", "microhertz", -6, 1, False),
    ("frequency", "millihertz", -3, 1, False),
    ("frequency", "hertz", 0, 1, False),
    ("frequency", "kilohertz", 3, 1, False),
    ("frequency", "megahertz", 6, 1, False),
    ("frequency", "gigahertz", 9, 1, False),
)

# -- Fixed values: concentration unit -> canonical sub-field it can be computed into
CONCENTRATION_UNITS = {"Molar": "molar"}

# -- Fixed values: prefix registry as (prefix, uri base, uri style, approximate)
PREFIXES = (
    ("uberon", "http://purl.obolibrary.org/obo/UBERON_", "obo_underscore", False),
    ("chebi", "http://purl.obolibrary.org/obo/CHEBI_", "obo_underscore", False),
    ("iao", "http://purl.obolibrary.org/obo/IAO_", "obo_underscore", False),
    ("pato", "http://purl.obolibrary.org/obo/PATO_", "obo_underscore", False),
    ("ncit", "http://purl.obolibrary.org/obo/NCIT_", "obo_underscore", False),
    ("schema", "https://schema.org/", "direct", False),
    ("allen_ccf_v3", "", "local", False),
    ("placeholder", "", "local", True),
)

# -- Fixed values: legacy class names -> current class names ---------------------
CLASS_RENAMES = {
    "ontologyImage": "ontology_image",
    "ontologyLabel": "ontology_label",
    "ontologyTableRow": "ontology_table_row",
    "imageCollection": "image_collection",
    "imageStack": "image_stack",
    "imageStack_parameters": "image_stack_parameters",
    "demoNDI": "demo_ndi",
    "demoNDIMock": "demo_ndi_mock",
    "SpikeInterfaceSortingOutputs": "spike_interface_sorting_outputs",
    "contrasttuning_calc": "contrast_tuning_calc",
    "contrastsensitivity_calc": "contrast_sensitivity_calc",
    "speedtuning_calc": "speed_tuning_calc",
}

# -- Fixed values: legacy field names -> current field names ---------------------
FIELD_RENAMES = {
    "ontologyName": "ontology_name",
    "ontologyNodes": "ontology_nodes",
    "dataType": "data_type",
    "nativeRate": "native_rate",
    "nativeStartTime": "native_start_time",
    "decimationLevels": "decimation_levels",
    "decimationSamplingRates": "decimation_sampling_rates",
    "decimationStartTimes": "decimation_start_times",
    "variableNames": "variable_names",
}

# -- Fixed values: classes without a successor (reported, never converted) --------
WITHDRAWN_CLASSES = ("stimloopsplitter_calc", "animalsubject", "subjectmeasurement")
