"""Reading landing files, keeping versioned tables, and the star-schema stand-ins."""
