"""Clinical record analytics on Spark: nested health records to analytic tables and back."""
