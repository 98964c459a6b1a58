"""Distributed text-recognition quality and document-curation engine on Spark DataFrames."""
