"""Lead-data engine on PySpark: contact mining, entity resolution, scoring, search and reports."""
