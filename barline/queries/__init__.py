"""Every operator as a query over the driver's tables, next to the SQL that checks it."""
