"""Column expressions and fixed values shared by every operator."""
