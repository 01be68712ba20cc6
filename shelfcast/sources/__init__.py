from shelfcast.sources.testdata import TableSource, sales_view  # noqa: F401
