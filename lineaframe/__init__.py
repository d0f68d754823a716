"""lineaframe: plans over immutable tables on Spark, with every answer traceable to its source rows."""
