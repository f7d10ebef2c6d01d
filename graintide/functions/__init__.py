"""graintide.functions"""
