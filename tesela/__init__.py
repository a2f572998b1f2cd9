"""Spark-native engine for open mobility records: flows, stays, trips and zones."""

__version__ = "0.1.0"

from tesela.api import Mobility, Zones, get_data_directory, set_data_directory

__all__ = ["Mobility", "Zones", "get_data_directory", "set_data_directory"]
