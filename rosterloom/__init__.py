"""Document-directory analytics as PySpark plans.

The package turns positioned page text into a reconciled directory of business
locations and answers workspace queries over it.  Everything is expressed with
DataFrame operations; grouped Python is used only where a rule is sequential.
"""
