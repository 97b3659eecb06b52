import __spark_entry__ as entry
from auditlake.sources.views import Tables

PATH = "/root/testdata/sf0.001"


def test_every_invoice_is_shown(spark):
    """Those in German or without a payment method too."""
    shown = entry.queries()["package_view"](spark, PATH)
    assert shown.count() == Tables(spark, PATH).v_invoice.count()
