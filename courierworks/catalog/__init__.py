"""The catalogue of reports; importing it registers all of them."""

from courierworks.catalog import context_reports, dispatch_reports, fleet_reports, mart_reports, model_reports, offer_reports, source_reports, stream_reports, text_reports, track_reports  # noqa: F401
from courierworks.catalog.registry import CHECKS, REPORTS

__all__ = ["CHECKS", "REPORTS"]
