"""Set-wise operators over document-page corpora on Spark."""
